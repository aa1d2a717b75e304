import itertools
import random

import pyarrow as pa
import pytest

from quarrylight.llm import sentencepiece_lattice as L

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=L.DEFAULT_MODEL)


ODD = ["", "a  b", " a", "a ", "\n", "a\nb", "  ", "\n\n  x \n", "Ａ é é", "a　b", "x\x00y", "<s> hi <0x0A>", "​ a", "ﬁ", "\U0001f600 ok", "x" * 5000, "the" * 3000 + " end", "١٢٣"]


def test_documents_equal_the_library(spark, sp, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate([*ODD, None, "▁x"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    encoded = L.encode_documents(df, hot=500)
    got = encoded.collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == sp.encode(text), text[:80]
        assert r["round_trip"] == (L.MARK not in text) and r["n_pieces"] == len(r["ids"])
    back = {r["doc_id"]: r["text"] for r in L.decode_documents(encoded).collect()}
    assert all(back[i] == (t or "") for i, t in rows if L.MARK not in (t or ""))


def test_lattice_equals_the_library(spark, sp):
    words = sorted({u for t in ODD for u in L.units(t) if len(u) < 40 and u != L.MARK} | {L.MARK + w for w in "tokenization running über naïve 日本語 0123 --- ''".split()})
    got = {r["word"]: r["ids"] for r in L.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), L.Model.load()).collect()}
    for w in words:
        want = sp.encode(w.removeprefix(L.MARK).replace(L.MARK, " ")) if w.startswith(L.MARK) else L.Model.load().encode_word(w)
        assert got[w] == want, w


def test_unigram_viterbi_equals_brute_force(spark):
    r = random.Random(4)
    pieces = [(c, i + 1, -6.0 - i / 7) for i, c in enumerate("abc")] + [("ab", 4, -5.0), ("bc", 5, -5.3), ("abc", 6, -9.1), ("ca", 7, -4.2), ("aab", 8, -7.7)]
    model = L.Model(pieces, None, 0)
    words = ["".join(r.choice("abcd") for _ in range(n)) for n in range(1, 9) for _ in range(4)]

    def brute(w):
        best = None
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            parts, cur = [], w[0]
            for c, k in zip(w[1:], cuts, strict=True):
                if k:
                    parts.append(cur)
                    cur = c
                else:
                    cur += c
            parts.append(cur)
            if all(p in model.scores or len(p) == 1 for p in parts):
                s = sum(model.scores.get(p, -1e6) for p in parts)
                best = max(best, s) if best is not None else s
        return best

    names = {i: p for p, i in model.ids.items()}
    for row in L.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), model, unigram=True).collect():
        assert abs(sum(model.scores.get(names.get(i), -1e6) for i in row["ids"]) - brute(row["word"])) < 1e-6


def test_empty(spark):
    assert L.encode_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_round_trip_is_decoded(spark, monkeypatch):
    """Without byte pieces an unknown character is lost, also in a hot word; so is a word whose hot row is wrong."""
    letters = [(c, i + 1, -1.0) for i, c in enumerate(L.MARK + "abc")]
    model = L.Model(letters, None, 0)
    monkeypatch.setattr(L.Model, "load", lambda path=None: model)
    rows = [(1, "ab abc"), (2, "ab xé xé"), (3, ""), (4, None), (5, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (100, 1):
        assert {r["doc_id"]: r["round_trip"] for r in L.encode_documents(df, hot=hot).collect()} == {1: True, 2: False, 3: True, 4: True, 5: True}
    shared = type("Shared", (), {"value": (model, {"ab": L.as_bytes([1, 2, 4])})})
    out = next(L._encode(shared, 256, iter([pa.record_batch([pa.array([1, 2]), pa.array(["ab", "ba"])], names=["doc_id", "text"])])))
    assert out.column("round_trip").to_pylist() == [False, True]
