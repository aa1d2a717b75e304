import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from quarrylight.llm import vector_codes as V

COLUMNS = "vec_id long, embedding array<double>, label int"


def brute(rows, entries=256, rounds=4):
    """Plain k-means on Python integers, every entry scanned for every part."""
    kept = [(i, [math.floor(1024 * Fraction(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = next((len(v) for _, v, _ in kept if v and len(v) % 4 == 0 and max(map(abs, v)) < V.RANGE), 0)
    fit = [r for r in kept if size and len(r[1]) == size and max(map(abs, r[1])) < V.RANGE]
    w = size // 4
    books = [[v[p * w : (p + 1) * w] for _, v, _ in fit[:entries]] for p in range(4)] if fit else []

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(e, x, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, v, _ in fit:
                x = v[p * w : (p + 1) * w]
                groups.setdefault(nearest(book, x)[1], []).append(x)
            for k, xs in groups.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, by_label = [], {}
    for i, v, label in kept:
        if not any(v is x for _, x, _ in fit):
            out.append((i, None, None, label))
            continue
        found = [nearest(books[p], v[p * w : (p + 1) * w]) for p in range(4)]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label.get(label), digest) for i, c, e, label in out), key=str)


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], COLUMNS + ", code string, x string").repartition(3)
    got = V.compress_vectors(df, **options).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, **options)


def test_documents_table_agrees_with_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in df.collect()]
    check(spark, rows, entries=40, rounds=4)
    whole = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = sorted(map(tuple, V.compress_vectors(whole).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)
    assert got == brute([(r["vec_id"], list(r["embedding"]), r["label"]) for r in whole.collect()])


def test_ties_repeats_and_clusters(spark):
    """Small integer grids make ties between entries; many equal vectors; negative sums round down."""
    r = random.Random(5)
    rows = [(r.randrange(400), [r.randint(-2, 1) / 1024 for _ in range(8)], r.choice([None, 1, 2])) for _ in range(500)]
    check(spark, rows, entries=30)
    check(spark, rows + [(900 + i, [0.5] * 8, 3) for i in range(200)], entries=256)


def test_edges(spark):
    """Null vectors, ids and components, ragged and empty vectors, wide and non-finite components, fewer vectors than entries."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2, 0.3, 0.4], 1), (2, [0.1, 0.2, 0.3, 0.4], None), (2, [-0.1, 0.2, 0.3, 0.4], None), (None, [9.0, 9.0, -9.0, 0.0], 1)]
    rows += [(3, None, 1), (4, [0.1, None, 0.2, 0.3], 1), (5, [nan, 0.0, 0.0, 0.0], 1), (6, [inf, 0.0, 0.0, 0.0], 1), (7, [1.0] * 8, 7), (0, [], 1), (8, [1.0] * 3, 1)]
    rows += [(9, [1e30, 0.0, 0.0, 0.0], 1), (10, [16000.0, -16000.0, 0.0, 0.0], 1), (11, [1e308, 0.0, 0.0, 0.0], 1)]
    check(spark, rows)
    check(spark, [r for r in rows if r[1] is None or len(r[1]) != 4])


def test_empty_table(spark):
    assert V.compress_vectors(spark.createDataFrame([], COLUMNS)).collect() == []


@pytest.mark.parametrize("scale", [3, 1 << 10, 1 << 23])
def test_search_is_exact(scale):
    """Every start leads to the nearest entry and the lowest index, also where distances need 64 bits."""
    r = np.random.default_rng(scale)
    entries, x = r.integers(-scale, scale, (50, 6)), r.integers(-scale, scale, (400, 6))
    entries[20:25] = entries[3]
    far = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    for start in (np.zeros(400, np.uint8), r.integers(0, 50, 400).astype(np.uint8), far.argmin(1).astype(np.uint8)):
        at, d = V.Neighbours(entries).nearest(x, start)
        assert (at == far.argmin(1)).all() and (d == far.min(1)).all()


def test_search_scans_less_than_everything(monkeypatch):
    """From its own cluster a vector looks at few entries."""
    r = np.random.default_rng(1)
    entries = r.integers(-(1 << 12), 1 << 12, (256, 2))
    x = np.repeat(entries, 20, axis=0) + r.integers(-20, 21, (5120, 2))
    n = V.Neighbours(entries)
    scanned = []
    whole = V.squared
    monkeypatch.setattr(V, "squared", lambda a, c: scanned.append(len(a) * len(c)) or whole(a, c))
    n.nearest(x, np.repeat(np.arange(256), 20))
    assert sum(scanned) == 5120 * V.BLOCK  # one block of four


def test_one_folder_of_codes_is_left(spark):
    import glob
    from quarrylight.session import shared_dir

    where = shared_dir(spark).removeprefix("file://") + "/quarrylight/*/codes"
    before = len(glob.glob(where))
    V.compress_vectors(spark.createDataFrame([(i, [float(i), 0.0, 1.0, 2.0], 1) for i in range(9)], COLUMNS)).collect()
    assert len(glob.glob(where)) == before + 1
