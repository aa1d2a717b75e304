import math
import random
import re

import numpy as np

from quarrylight.llm.quality_rules import CUTOFF, consistency, quality_rules, text_statistics

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = W.findall(text)
    lines = [x for x in text.split("\n") if W.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string")
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r["doc_id"]: tuple(r[c] for c in cols) for r in text_statistics(df).collect()}
    assert got == {r[0]: brute(r[1]) for r in rows}


def test_statistics_match_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"], None, "s", None) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    odd = [None, "", " \n\t", "a", "é ü\x0bß\x0c#*", "a b c d e " * 40, "x y\nx y\n\n \nx y\r\nx y", "a a a a a a", "a\x00b a\x00b",
           " ".join(f"w{i % 977}" for i in range(9000)), "z " * 50000]
    check(spark, docs + [(10_000 + i, t, None, None, "clash") for i, t in enumerate(odd)])


def test_outliers_go_and_clean_stay(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {r["doc_id"]: r for r in quality_rules(df).collect()}
    assert len(out) == df.count()
    for r in df.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect():
        if out[r["doc_id"]]["n_symbols"] > 0.25 * out[r["doc_id"]]["word_chars"]:
            assert not out[r["doc_id"]]["kept"]
        elif r["quality"] == 1:
            assert out[r["doc_id"]]["kept"] or out[r["doc_id"]]["n_words"] < 10


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality_rules(df).collect() == []


def test_symbols_after_many_words_go_and_one_symbol_stays(spark):
    """A share of 0.1 symbols a word character is far outside a pool without any."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9)))
    texts = [[word() for _ in range(r.randint(60, 300))] for _ in range(240)]
    marked = lambda t: " ".join(w + " |" * (k % 3 > 0) for k, w in enumerate(t))
    rows = [(i, marked(t) if i < 12 else " ".join(t) + " #" * (i < 20), "en", "s") for i, t in enumerate(texts)]
    out = {x["doc_id"]: x["kept"] for x in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {i for i, kept in out.items() if not kept} == set(range(12))


def test_the_estimate_rules_where_there_is_a_spread(spark):
    """The same mean word length is an outlier of a source with even words and none of a source with uneven ones."""
    r = random.Random(7)
    text = lambda mean: " ".join("".join(r.choice("abcdefghij") for _ in range(max(2, round(r.gauss(mean, 1))))) for _ in range(300))
    rows = [(i, text(6), "en", "even") for i in range(200)] + [(1000 + i, text(r.uniform(4, 9)), "en", "uneven") for i in range(200)]
    rows += [(5000, text(8), "en", "even"), (5001, text(8), "en", "uneven")]
    out = {x["doc_id"]: x["kept"] for x in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not out[5000] and out[5001] and sum(out.values()) == len(rows) - 1


GUARDS = np.array([0.005, 0.05, 0.06, 0.06])


def quantile(x, q):
    """The element that percentile_approx gives for few rows: the first with q of all at or below it."""
    return np.sort(x)[max(0, math.ceil(q * len(x)) - 1)]


def scatter(x):
    """(mean, Cholesky factor) with variances under the guards replaced."""
    m, c = x.mean(0), (x[:, :, None] * x[:, None, :]).mean(0) - np.outer(x.mean(0), x.mean(0))
    low = np.zeros((4, 4))
    for i in range(4):
        for j in range(i + 1):
            v = (max(c[i, i], GUARDS[i] ** 2) if i == j else c[i, j]) - low[i, :j] @ low[j, :j]
            low[i, j] = math.sqrt(max(v, GUARDS[i] ** 2 / 4)) if i == j else v / low[j, j]
    return m, low


def distances(x, m, low):
    return (np.linalg.solve(low, (x - m).T) ** 2).sum(0)


def brute_distances(texts):
    """Distances of one pool's texts by minimum covariance determinant, written down again from its definition."""
    rows = [(*brute(t), len([y for y in (t or "").split("\n") if W.search(y)])) for t in texts]
    x = np.array([[math.log(1 + c / max(n, 1)), math.log(0.02 + s / (c + 200)), math.sqrt(d / (lines + 10)), math.sqrt(r / (n + 400))] for n, c, s, d, r, lines in rows])
    n = np.array([r[0] for r in rows])
    x[:, 0] = (x[:, 0] - quantile(x[:, 0], 0.5)) * np.sqrt(n / (n + 400))
    gap = np.abs(x - [quantile(x[:, k], 0.5) for k in range(4)])
    unit = np.maximum([quantile(gap[:, k], 0.5) for k in range(4)], GUARDS)
    sums = [(gap / GUARDS).sum(1), (gap / unit).sum(1)]
    found = []
    for keep in [s <= quantile(s, 0.75) for s in sums] + [np.ones(len(x), bool)]:
        m, low = scatter(x[keep])
        while True:
            d = distances(x, m, low)
            m2, low2 = scatter(x[d <= quantile(d, 0.75)])
            if not 2 * np.log(np.diag(low2)).sum() < 2 * np.log(np.diag(low)).sum() - 0.01:
                break
            m, low = m2, low2
        found.append((2 * np.log(np.diag(low)).sum(), len(found), m, low))
    _, _, m, low = min(found, key=lambda f: f[:2])
    m, low = scatter(x[distances(x, m, low) <= CUTOFF * consistency(0.75)])
    return distances(x, m, low)


def test_distances_and_verdicts_match_brute_force(spark):
    """Two sources with spreads of their own, with outliers in each; every distance and every verdict."""
    r = random.Random(8)
    word = lambda mean: "".join(r.choice("abcdefghij") for _ in range(max(2, round(r.gauss(mean, 1.5)))))

    def text(mean, symbols, repeats):
        lines = [" ".join(word(mean) + (" #" if r.random() < symbols else "") for _ in range(r.randint(4, 15))) for _ in range(r.randint(3, 20))]
        return "\n".join(lines + lines[: r.randint(0, repeats)])

    pools = {"a": [text(6, 0, 0) for _ in range(150)] + [text(9, 0, 0), text(6, 0.5, 0), text(6, 0, 3)], "b": [text(r.uniform(4, 8), r.choice([0, 0.1, 0.2]), 3) for _ in range(130)] + [text(14, 0.9, 3)]}
    rows = [(k * 1000 + i, t, "en", s) for k, (s, texts) in enumerate(pools.items()) for i, t in enumerate(texts)]
    out = {x["doc_id"]: x for x in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    for k, texts in enumerate(pools.values()):
        for i, (t, d) in enumerate(zip(texts, brute_distances(texts), strict=True)):
            got, (n, _, _, _, repeat) = out[k * 1000 + i], brute(t)
            assert math.isclose(got["distance"], d, rel_tol=1e-6, abs_tol=1e-9)
            assert got["kept"] == (n >= 10 and 100 * repeat <= 20 * n and d <= CUTOFF)


def test_consistency_factor_of_normal_data():
    x = np.random.default_rng(5).normal(size=(200_000, 4))
    d = (x**2).sum(1)
    assert abs(x[d <= np.quantile(d, 0.75)].var() * consistency(0.75) - 1) < 0.02


def test_repeated_rows_nulls_and_clashes(spark):
    """Repeated rows agree; null ids, texts, languages and sources are judged; columns named like the operator's own don't matter."""
    rows = [(1, "one two three four five six seven eight nine ten", None, None)] * 3 + [(None, "a b c d e f g h i j k", "en", "s"), (None, None, "en", "s"), (2, "", None, "s")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, distance string, _pool string")
    out = quality_rules(df).collect()
    assert len(out) == len(rows) and len({tuple(r) for r in out if r["doc_id"] == 1}) == 1
    assert sorted(r["base_failed"] for r in out) == [False] * 4 + [True] * 2
