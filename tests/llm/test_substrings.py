import hashlib
import random
import re

import pytest

from quarrylight.llm import substrings

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    first = {}
    for i, t in rows:
        w = W.findall(t or "")
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            first[k] = min(i, first.get(k, i))
    out = {}
    for i, t in rows:
        w = W.findall(t or "")
        gone = {x for s in range(len(w) - length + 1) if first[tuple(w[s : s + length])] < i for x in range(s, s + length)}
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def check(spark, rows, length=50):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substrings.dedup_substrings(df, length).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute(rows, length)


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    odd = [None, "", "a b", "be " * 300, "be " * 49, "be " * 50, "x " + "be " * 60 + "y", "é\tü\n" * 80]
    check(spark, rows + [(50_000 + i, t) for i, t in enumerate(odd)])


@pytest.mark.parametrize("shard", [1, 3, 2048])
def test_passages_edits_and_shifts(spark, monkeypatch, shard):
    """Also with shards so small that they are dealt again and again."""
    monkeypatch.setattr(substrings, "SHARD", shard)
    r = random.Random(shard)
    words = [f"w{i}" for i in range(40)]
    passages = [[r.choice(words) for _ in range(n)] for n in (50, 51, 64, 90, 200)]
    rows = []
    for i in range(150):
        text = []
        for _ in range(r.randint(1, 4)):
            p = list(r.choice(passages))
            if r.random() < 0.3:
                p[r.randrange(len(p))] = "edit"
            text += [r.choice(words) for _ in range(r.randint(0, 30))] + p[r.randint(0, 5) :]
        rows.append((i * 7 % 151, " ".join(text)))
    check(spark, rows)


def test_empty(spark):
    assert substrings.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_automaton_matching_statistics():
    r = random.Random(2)
    seqs = [[r.choice("ab") for _ in range(30)] for _ in range(6)]
    a = substrings.SuffixAutomaton()
    for s in seqs:
        a.add(s)
    have = {tuple(s[i:j]) for s in seqs for i in range(31) for j in range(i + 1, 31)}
    q = [r.choice("abc") for _ in range(200)]
    want = [max([0] + [n for n in range(1, min(31, i + 2)) if tuple(q[i + 1 - n : i + 1]) in have]) for i in range(200)]
    assert list(a.matches(q)) == want


def test_edges(spark):
    """Null ids stay whole; repeated rows of an id agree; ties, long texts; carried columns of any name."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(7, text), (7, text), (3, text), (None, text), (None, None), (9, None), (4, "long " * 60_000), (5, "long " * 60_000 + "end")]
    names = ["ranges", "n_words", "kept_text", "odd.name", "_row", "pick"]
    df = spark.createDataFrame([(*r, *range(6)) for r in rows], "doc_id int, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = substrings.dedup_substrings(df.repartition(3), 50, text_out=True, keep=names).collect()
    assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"])) for r in got) == sorted(
        str(x) for x in [(7, 80, 80), (7, 80, 80), (3, 80, 0), (None, 80, 0), (None, 0, 0), (9, 0, 0), (4, 60_000, 0), (5, 60_001, 60_000)]
    )
    assert all([r["carried"][n] for n in names] == list(range(6)) for r in got)
