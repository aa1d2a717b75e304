import math
import random
import re
import string

import pytest

from quarrylight.llm import minhash

W = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, k):
    w = W.findall((text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    post = {}
    for i, s in sets.items():
        for g in s:
            post.setdefault(g, []).append(i)
    seen = set()
    for ids in post.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def check(spark, rows, k=3, percent=85):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df, k, percent).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute(rows, k, percent)


def edited(n_words, edits, seed):
    return " ".join(f"new{seed}x{i}" if i % max(1, n_words // max(edits, 1)) == 0 and edits and i else f"w{i}" for i in range(n_words))


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    odd = [None, "", " \t", "a", "A", "a b", "a B", "a b c", "b a", "x " * 3000, "x " * 3001]
    check(spark, rows + [(50_000 + i, t) for i, t in enumerate(odd)])


@pytest.mark.parametrize("first_word", [0, 60])
def test_crowd_of_copies_with_own_edits(spark, first_word):
    rows = [(i, edited(200, i % 12, i)) for i in range(90)] + [(900 + i, edited(200 + first_word, 5, i)) for i in range(5)]
    check(spark, rows)


def test_families_around_the_threshold_keep_every_link(spark):
    """Families whose members are more and less similar than asked for: at least 0.9 of the true links, here all of them."""
    r = random.Random(11)
    rows = []
    for family in range(40):
        base = [f"f{family}w{i}" for i in range(r.randint(20, 160))]
        for _ in range(6):
            rows.append((len(rows), " ".join(f"x{r.random()}" if r.random() < 0.004 * (family % 16) else w for w in base)))
    check(spark, rows)
    check(spark, rows, 5, 80)


def test_edges(spark):
    """Null ids, repeated rows, ties, very long texts and clashing columns."""
    text = edited(300, 0, 0)
    rows = [(7, text), (7, text), (3, text + " more"), (None, text), (None, None), (5, "long " * 100_000), (4, "long " * 100_001), (9, None)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id int, text string, component_id string, rep string, h string").repartition(3)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, 3, 85).collect()), key=str)
    assert got == sorted([(7, 3, False), (7, 3, False), (3, 3, True), (None, None, True), (None, None, True), (5, 4, False), (4, 4, True), (9, 9, True)], key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df).collect() == []


def test_threshold_misses_next_to_nothing():
    for s in (0.8, 0.85):
        t, n = minhash.match_threshold(s), minhash.COORDS
        assert sum(math.comb(n, k) * s**k * (1 - s) ** (n - k) for k in range(t)) < 1e-6 and t > n // 2 - 2
