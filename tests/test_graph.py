import random

import pytest

from quarrylight.operators import graph as G


def brute_scc(edges):
    nodes = {n for e in edges for n in e}
    out = {n: {b for a, b in edges if a == n} for n in nodes}

    def reach(n):
        seen, todo = set(), list(out[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        return seen

    r = {n: reach(n) for n in nodes}
    return {n: min(m for m in nodes if m in r[n] and n in r[m]) for n in nodes if n in r[n]}


def brute_levels(nodes, edges):
    level = {}
    while True:
        ready = {n: max((level[b] + 1 for a, b in edges if a == n), default=0) for n in nodes if n not in level and all(b in level for a, b in edges if a == n)}
        if not ready:
            return {n: level.get(n) for n in nodes}
        level |= ready


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = sorted({(r.randrange(40), r.randrange(40)) for _ in range(38)} | {(50, 51), (51, 52), (52, 50), (60, 60), (61, 60), (70, 71)})
    df = spark.createDataFrame(edges + edges[:4], "source long, target long")
    assert {x["node"]: x["component"] for x in G.strongly_connected(df).collect()} == brute_scc(edges)
    nodes = [n for n in range(80) if n != 71]
    forward = [(max(e), min(e)) for e in edges if r.random() < 0.9 and e[0] != e[1]] + [(60, 60), (61, 60), (50, 51), (51, 50)]
    got = G.kahn_levels(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(forward, "source long, target long"))
    assert {x["node"]: x["level"] for x in got.collect()} == brute_levels(nodes, set(forward))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """10,000 nodes in a row, and the same closed to a ring with a tail: settled tables stay under a hundred for under 40 rounds."""
    n, tables, whole = 10_000, [], G.settle
    monkeypatch.setattr(G, "settle", lambda df, *a, **k: tables.append(1) or whole(df, *a, **k))
    line = spark.range(1, n).selectExpr("id AS source", "id - 1 AS target")
    levels = G.kahn_levels(spark.range(n).withColumnRenamed("id", "node"), line)
    assert levels.filter("level = node").count() == n and len(tables) < 40
    tables.clear()
    ring = line.unionByName(spark.createDataFrame([(0, n - 1), (n + 5, 7)], "source long, target long"))
    got = G.strongly_connected(ring)
    assert got.filter("component = 0").count() == n == got.count() and len(tables) < 60


def test_inference_reaches_what_lies_deep(spark):
    """Nodes over 64 edges behind a root are no orphans; a circle that no root leads to is."""
    edges = [(i, i + 1) for i in range(66)] + [(200, 201), (201, 200)]
    nodes = [(i,) for i in [*range(67), 100, 200, 201]]
    got = G.inference(spark.createDataFrame(nodes, "node long").coalesce(1), spark.createDataFrame(edges, "source long, target long").coalesce(1), 100)
    assert sorted((r["relation"], r["node"]) for r in got.collect()) == [("cyclic", 200), ("cyclic", 201), ("orphan", 200), ("orphan", 201)]
