import random
import re
import string

import numpy as np
import pytest
import xxhash

from quarrylight.llm import simhash as S

W = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_print(text, k=3):
    w = W.findall((text or "").translate(LOW))
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h))


def groups(prints, radius=2):
    """{row: component_id} for (doc_id, fingerprint) rows, every pair compared."""
    rows = [(i, r) for r, (i, _) in enumerate(prints) if i is not None]
    root = {r: r for _, r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (_, a) in enumerate(rows):
        for _, b in rows[n + 1 :]:
            if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[y] = x
    least = {}
    for i, r in rows:
        least[find(r)] = min(i, least.get(find(r), i))
    return [None if i is None else least[find(r)] for r, (i, _) in enumerate(prints)]


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fingerprint string, class int").repartition(3)
    got = S.simhash_groups(df, **options).collect()
    prints = [(i, plain_print(t)) for i, t in rows]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, groups(prints), strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_documents(spark):
    check(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def test_edges(spark):
    """Nulls, empty and very long texts, few words, repeated rows and ids, rows without an id, other scripts."""
    rows = [(5, None), (4, ""), (9, " \t\n\x0b"), (None, None), (None, "one two three four"), (7, "one two three four"), (6, "One  TWO\nthree four"), (6, "another text here entirely")]
    rows += [(1, "a"), (2, "a b"), (2, "a b"), (3, "É é \U0001f600 中文 ß"), (8, "A\xa0b c d"), (10, "long words repeat " * 50_000), (11, "long words repeat " * 50_001)]
    check(spark, rows)


def test_chains_of_near_copies(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(400)]
    rows = []
    for i in range(150):
        rows.append((1000 - i, " ".join(base)))
        base[r.randrange(400)] = f"new{i}"
    check(spark, rows)


def test_empty(spark):
    assert S.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("tile", [7, 1 << 15])
def test_links_keep_every_component(spark, tile):
    """Crowded and random fingerprints, whole and in small tiles: reachability as in a comparison of all pairs; few links."""
    r = random.Random(8)
    values = [r.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1, 1, 3, 1 << 63, 0xFFFF << 48]
    for _ in range(500):
        v = r.choice(values)
        for _ in range(r.randrange(4)):
            v ^= 1 << r.randrange(64)
        values.append(v)
    values = sorted(set(values))
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fingerprint long")
    found = S.near_fingerprints(df, 2, tile).collect()
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        x, y = find(a % (1 << 64)), find(b % (1 << 64))
        root[max(x, y)] = min(x, y)
    assert [find(v) for v in values] == [groups_of for groups_of in groups([(v, v) for v in values])]


def test_crowd_returns_few_links():
    ball = np.array(sorted({1 << i | 1 << j for i in range(64) for j in range(64)}), np.uint64).view(np.int64)
    assert sum(len(a) for a, _ in S.links(ball, ball, 2)) < 3 * len(ball) * (1 + len(ball) ** 2 // S.STEP)
