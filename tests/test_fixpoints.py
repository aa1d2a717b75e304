import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from quarrylight.functions.evidence import _redacted, redact_body
from quarrylight.operators import graph as G
from quarrylight.operators import lifecycle as L
from quarrylight.operators import relational as R


def test_cascade_goes_to_the_end_of_a_chain_and_out_of_a_circle(spark):
    links = [("a", i, "a", i + 1) for i in range(25)] + [("a", 25, "b", 0), ("b", 0, "b", 1), ("b", 1, "b", 0), ("a", 3, "a", 20), ("z", 1, "z", 2), ("a", 4, "a", None), ("a", None, "a", 99)]
    got = L.cascade(spark.createDataFrame([("a", 0), ("a", 0), ("a", None)], "kind string, id long"), spark.createDataFrame(links, "from_kind string, from_id long, to_kind string, to_id long"))
    want = {("a", i): i for i in range(20)} | {("a", i): min(i, 4 + i - 20) for i in range(20, 26)} | {("b", 0): 10, ("b", 1): 11}
    assert {(r["kind"], r["id"]): r["round"] for r in got.collect()} == want


def test_what_a_new_index_makes_stale(spark):
    files = spark.createDataFrame([(1, "a", "b", True, True), (2, "a", "a", True, False), (3, "a", "a", True, True), (4, None, "x", False, True)], "file_id long, old_hash string, new_hash string, was_active boolean, is_active boolean")
    symbols = spark.createDataFrame([(10, 1, True, True), (11, 3, True, False), (12, 3, True, True)], "symbol_id long, file_id long, was_active boolean, is_active boolean")
    relations = spark.createDataFrame([(100, 12, None, 12, 3, 1, 500), (101, 12, 11, None, 3, 3, None), (102, 12, 12, 12, 3, 3, 501), (103, 10, None, None, 4, 4, 502)], "relation_id long, subject long, container long, target long, occurrence_file long, target_file long, edge_id long")
    imports = spark.createDataFrame([(200, 3, 2, 503), (201, 3, 4, 504)], "import_id long, source_file long, target_file long, edge_id long")
    got = {(r["kind"], r["id"]) for r in L.invalidate_semantics(files, symbols, relations, imports).collect()}
    assert got == {("relation", 100), ("edge", 500), ("relation", 101), ("import", 200), ("edge", 503), ("state", 10), ("state", 11)}


def test_only_what_is_stale_is_written(spark, monkeypatch):
    """Relations and imports are not written as links; ids that repeat, and null ends, ids and edges, give each stale row once."""
    written, settle = [], L.settle
    monkeypatch.setattr(L, "settle", lambda df, *more: written.append(settle(df, *more)) or written[-1])
    files = spark.createDataFrame([(1, "a", "b", True, True), (1, "a", "b", True, True), (2, "a", "a", True, True)], "file_id long, old_hash string, new_hash string, was_active boolean, is_active boolean")
    symbols = spark.createDataFrame([(10, 2, True, True), (None, 1, True, False)], "symbol_id long, file_id long, was_active boolean, is_active boolean")
    rows = [(i, 10, None, None, 2, 2, i) for i in range(100, 400)] + [(7, 10, None, None, 1, 1, None), (7, None, None, None, 2, 2, 900), (None, 10, None, None, 1, 2, 901)]
    relations = spark.createDataFrame(rows, "relation_id long, subject long, container long, target long, occurrence_file long, target_file long, edge_id long")
    imports = spark.createDataFrame([(8, 1, 1, 900)], "import_id long, source_file long, target_file long, edge_id long")
    got = sorted((r["kind"], r["id"], r["round"]) for r in L.invalidate_semantics(files, symbols, relations, imports).collect())
    assert got == [("edge", 900, 2), ("import", 8, 1), ("relation", 7, 1)]
    assert max(t.count() for t in written) < 10


def test_digest_trees_find_every_change_and_little_else(spark):
    r = random.Random(4)
    old = {(b, k): "x" for b in "pq" for k in r.sample(range(5000), 2000)}
    new = dict(old)
    for at in r.sample(sorted(old), 6):
        new[at] = "y"
    gone = r.sample(sorted(old), 3)
    for at in gone:
        new.pop(at)
    new["q", 9999], new["r", 1] = "x", "x"
    tables = [spark.createDataFrame([(*k, v) for k, v in d.items()], "b string, k long, h string") for d in (old, new)]
    trees = [R.digest_tree(t, "b", "k", F.concat_ws(":", F.col("k").cast("string"), "h"), 8) for t in tables]
    blocks = R.differing_blocks(*trees, "b", 8)
    assert {tuple(x) for x in R.tree_changes(*tables, blocks, "b", "k", "h", 8).collect()} == {(*k, "added" if k not in old else "removed" if k not in new else "changed") for k in old.keys() | new.keys() if old.get(k) != new.get(k)}
    assert blocks.count() <= 11
    same = R.differing_blocks(trees[0], trees[0], "b", 8)
    assert same.count() == 0
    roots = R.block_digest(tables[0], "b", "k", F.concat_ws(":", F.col("k").cast("string"), "h"), 8)
    assert {tuple(x) for x in roots.collect()} == {(x["b"], x["digest"]) for x in trees[0].filter("level = 2").collect()}


@pytest.mark.parametrize("seed", range(2))
def test_all_shortest_paths_match_brute_force(spark, seed):
    r = random.Random(seed)
    edges = sorted({(r.randrange(14), r.randrange(14)) for _ in range(40)})
    start, most = [0, 1], 2
    depth, level, paths = {s: 0 for s in start}, {s: [(s,)] for s in start}, {s: [(s,)] for s in start}
    for d in itertools.count(1):
        step = {}
        for a, b in edges:
            if a in level and b not in depth:
                step.setdefault(b, []).extend(p + (b,) for p in level[a])
        if not step:
            break
        depth |= dict.fromkeys(step, d)
        paths |= step
        level = step
    want = {(n, depth[n], len(ps), i + 1, p) for n, ps in paths.items() for i, p in enumerate(sorted(ps)[:most])}
    got = G.all_shortest_paths(spark.createDataFrame(edges + edges[:3], "source long, target long"), spark.createDataFrame([(s,) for s in start], "node long"), most)
    assert {(x["node"], x["depth"], int(x["paths"]), x["place"], tuple(x["path"])) for x in got.collect()} == want


def test_json_is_withheld_at_every_depth(spark):
    deep = {"a": [{"b": {"Session-Id": {"x": [1]}, "ok": [True, None, 1.5, "é"]}}], "api_key": 3, "notes": {"user_email_address": "e"}}
    want = {"a": [{"b": {"Session-Id": "<redacted>", "ok": [True, None, 1.5, "é"]}}], "api_key": "<redacted>", "notes": {"user_email_address": "<redacted>"}}
    assert json.loads(_redacted(json.dumps(deep))) == want
    assert _redacted("[" * 200 + "]" * 200) is None and _redacted("{} x") is None and _redacted(None) is None and _redacted("NaN") is None
    rows = [(json.dumps({"t": {"password": {"deep": "hunter2"}}}),), ("password = hunter2",), (None,), ("",), ('{"v": "hunter2"}',)]
    got = [r[0] for r in spark.createDataFrame(rows, "b string").coalesce(1).select(redact_body(F.col("b"), ["hunter2"])).collect()]
    assert got == ['{"t":{"password":"<redacted>"}}', "password = <redacted>", None, "", '{"v":"<redacted>"}']
