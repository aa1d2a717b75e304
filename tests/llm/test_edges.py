"""Edge cases of operators by table (null ids and texts, empty tables, repeats, long texts, clashing columns), and models against plain versions."""

import math
import random

import numpy as np
import pytest

from quarrylight.llm import chat, decontaminate, kernels, licences, quality_model, sentencepiece_lattice, toxicity, warc

CLASHES = ["id", "h", "x", "y", "w", "n", "place", "words", "ids", "score", "held_out", "labels", "key", "bundle", "rendered", "contaminated"]
TEXTS = [(1, "plain words of a text here"), (1, "plain words of a text here"), (2, None), (3, ""), (None, "plain words of a text here"), (None, None), (4, "long words " * 60_000), (5, " \t\n\x0b"), (6, "é ü ß 中文 \U0001f600")]


def docs(spark, rows):
    return spark.createDataFrame([(*r, *["c"] * len(CLASHES)) for r in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(3)


def benchmark(spark):
    return spark.createDataFrame([(1, "plain words of a text here", "q"), (None, "x y z", "q"), (2, None, "q")], "item_id long, text string, h string")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality_model": lambda s, d: quality_model.score_quality(d, labels(s)),
    "sentencepiece": lambda s, d: sentencepiece_lattice.encode_documents(d),
    "decontaminate": lambda s, d: decontaminate.decontaminate(d, benchmark(s)),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, labels(s)),
    "licences": lambda s, d: licences.scan_licences(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, name):
    rows = OPERATORS[name](spark, docs(spark, TEXTS)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in TEXTS)
    assert len({tuple(map(str, r)) for r in rows if r["doc_id"] == 1}) == 1
    for c in ("held_out", "predicted", "score", "contaminated", "n_pieces", "n_words", "round_trip"):
        assert all(r[c] is not None for r in rows if c in r)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_decontaminate_finds_named_rows(spark):
    out = {(r["doc_id"], r["contaminated"]) for r in decontaminate.decontaminate(docs(spark, TEXTS), benchmark(spark)).collect()}
    assert out == {(1, True), (None, False), (2, False), (3, False), (4, False), (5, False), (6, False)}


def test_short_template_ends_where_it_ends(spark):
    """A four-word item at words 2 to 5 of nine."""
    d = spark.createDataFrame([(1, "aa bb alpha beta gamma delta cc dd ee")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "alpha beta gamma delta")], "item_id long, text string")
    assert {(r["first_word"], r["last_word"]) for r in decontaminate.find_leaks(d, b).collect()} == {(2, 5)}


def test_warc_edges(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (None, None, "same"), (None, "u", "alone"), (3, "u", "same"), (4, None, None), (5, "u", "")]
    df = spark.createDataFrame([(*r, "c", "c", "c") for r in rows], "page_id long, url string, html string, bundle string, _digest string, key string").repartition(3)
    out = warc.archive_pages(df).collect()
    assert all(r["intact"] for r in out)
    got = sorted(str((r["page_id"], r["record_type"], r["refers_to"])) for r in out)
    want = [(1, "revisit", 3), (1, "revisit", 3), (None, "revisit", 3), (None, "response", None), (3, "response", None), (4, "revisit", 5), (5, "response", None)]
    assert got == sorted(map(str, want))


def test_chat_edges(spark):
    """Null ids are left out; repeats count once; ties between conversations go to the smaller id; other columns don't matter."""
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, None, None), (None, 0, "user", "a"), (4, None, "user", "x"), (4, 0, "bot", "y" * 200_000)]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "conv_id long, turn long, role string, text string, place string, block string")
    got = {(r["conv_id"], r["n_turns"], r["n_copies"]) for r in chat.format_chats(df).collect()}
    assert got == {(1, 2, 2), (4, 2, 1)}
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


# ------------------------------------------------------------------ models


def plain_ftrl(examples, order):
    """FTRL-proximal on dictionaries, one coordinate after the other."""
    t, z, n = toxicity, {}, {}

    def weight(f):
        zi, ni = z.get(f, 0.0), n.get(f, 0.0)
        return 0.0 if abs(zi) <= t.L1 else -(zi - math.copysign(t.L1, zi)) / ((t.BETA + math.sqrt(ni)) / t.ALPHA + t.L2)

    for i in order:
        features, y = examples[i]
        w = {f: weight(f) for f in features}
        g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y
        for f in features:
            sigma = (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / t.ALPHA
            z[f] = z.get(f, 0.0) + g - sigma * w[f]
            n[f] = n.get(f, 0.0) + g * g
    return {f: weight(f) for f in z if weight(f) != 0}


def test_ftrl_matches_a_plain_version():
    r = np.random.default_rng(3)
    examples = []
    for _ in range(300):
        y = int(r.random() < 0.4)
        examples.append((np.unique(np.append(r.integers(0, 60, 8), 100 + y if r.random() < 0.8 else 5)).astype(np.uint32), y))
    names, weights = toxicity.fit(examples)
    order, shuffle = [], np.random.Generator(np.random.PCG64(7))
    for _ in range(toxicity.EPOCHS):
        order += shuffle.permutation(len(examples)).tolist()
    bias = 1 << toxicity.DIM_BITS
    want = plain_ftrl([([*map(int, f), bias], y) for f, y in examples], order)
    assert set(map(int, names)) == set(want) and all(math.isclose(w, want[int(f)], rel_tol=1e-9) for f, w in zip(names, weights, strict=True))
    assert 101 in want and 100 in want


def test_features_are_words_pairs_and_skips():
    """As many distinct features as distinct words, pairs and pairs with one word skipped of the text in lower case."""
    r = random.Random(4)
    texts = [" ".join(r.choice(["A", "b", "C,", "d-e", "é"]) for _ in range(n)) for n in (0, 1, 2, 3, 40)]
    raw = "".join(texts).encode()
    offs = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    doc, feat = toxicity.feature_arrays(np.frombuffer(raw, np.uint8), offs)
    for i, t in enumerate(texts):
        w = t.lower().replace(",", " ").replace("-", " ").split()
        want = {(0, a) for a in w} | {(1, a, b) for a, b in zip(w, w[1:])} | {(2, a, b) for a, b in zip(w, w[2:])}
        assert len(np.unique(feat[doc == i])) == len(want)


def plain_tree(grad, hess, leaves):
    """Greedy best cuts, every cut of every part tried."""
    cuts = [0, len(grad)]
    value = lambda a, b: sum(grad[a:b]) / (sum(hess[a:b]) + 1.0)
    score = lambda a, b: sum(grad[a:b]) ** 2 / (sum(hess[a:b]) + 1.0)
    for _ in range(leaves - 1):
        gains = [(score(a, k) + score(k, b) - score(a, b), k) for a, b in zip(cuts, cuts[1:]) for k in range(a + 1, b)]
        if not gains or max(gains)[0] <= 1e-9:
            break
        cuts = sorted([*cuts, max(gains)[1]])
    return [value(a, b) for a, b in zip(cuts, cuts[1:]) for _ in range(a, b)]


def test_trees_match_exhaustive_cuts():
    r = np.random.default_rng(6)
    for n in (1, 2, 5, 32):
        for _ in range(20):
            g, h = r.normal(size=n), r.uniform(0.01, 1, n)
            assert np.allclose(quality_model._tree(g, h), plain_tree(g.tolist(), h.tolist(), quality_model.LEAVES))


def test_scores_are_sums_of_table_entries():
    r = np.random.default_rng(9)
    x = r.normal(size=(500, 5))
    model = quality_model.fit(x, (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(int))
    got = quality_model.predict(model, x[:50])
    for row, p in zip(x, got):
        bins = [sum(v >= e for e in edges) for v, edges in zip(row, model["edges"])]
        raw = model["bias"] + sum(t[b] for t, b in zip(model["tables"], bins))
        coarse = [b * quality_model.PAIR_BINS // len(t) for b, t in zip(bins, model["tables"])]
        raw += sum(t[coarse[a] * quality_model.PAIR_BINS + coarse[b]] for (a, b), t in zip(model["pairs"], model["pair_tables"]))
        assert math.isclose(p, 1 / (1 + math.exp(-raw)), rel_tol=1e-9)


def test_hashes_of_words_do_not_depend_on_where_they_stand():
    raw = b"ab cd  ab\ncd"
    w = kernels.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3] and w.hash[0] != w.hash[1]
