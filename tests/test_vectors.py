import random

import pytest

from quarrylight.operators.vectors import top_k


def brute(rows, queries, k):
    out = []
    for q, x in queries:
        scored = [(round(sum(a * b for a, b in zip(x, y, strict=True)), 5), i) for i, y in rows if i != q]
        best = sorted((-s, i) for s, i in scored if s > 0)[:k]
        out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("tile", [16, 1 << 18])
def test_agrees_with_brute_force(spark, tile):
    """Many ties, negative scores, fewer rows than k in a tile."""
    r = random.Random(3)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    got = top_k(df, df.filter("id % 10 = 0"), 7, tile).select("query", "id", "score", "place").collect()
    assert sorted(map(tuple, got)) == brute(rows, rows[::10], 7)


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [1.0, None]), (5, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (6, [float("nan"), 1.0]), (7, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    assert [tuple(r) for r in top_k(df, df, 3).orderBy("query", "place").collect()] == [(1, 2, 1.0, 1), (2, 1, 1.0, 1)]
    assert top_k(df.limit(0), df, 3).collect() == [] and top_k(df, df.limit(0), 3).collect() == []
