import re
import string
from collections import Counter, defaultdict

import pytest

from quarrylight.llm import divergence
from tests.oracle import compare, connect

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
COLUMNS = "doc_id long, text string, lang string, source string"


def brute(rows, min_docs=10, top=10):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        groups.add((lang, source))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        vocabulary = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = sorted(s for g, s in groups if g == lang)
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])

        def shares(c, vocabulary=vocabulary):
            n = sum(c[t] for t in vocabulary)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(vocabulary)) for t in vocabulary}

        p, q = {s: shares(count[lang, s]) for s in sources}, shares(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in vocabulary)) for o in sources if o != s]
            term = [(t, f(p[s][t], q[t])) for t in vocabulary if count[lang, s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS + ", term string, n int").repartition(3)
    got = divergence.source_divergence(df).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_agrees_with_brute_force_on_documents(spark):
    check(spark, [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").collect()])


def test_edges(spark):
    """Nulls, empty and very long texts, repeated rows, ties, groups without terms, a language that keeps no term."""
    rows = [(i, "Apple pear Ärger ärger 中文\U0001f600 é2x", "a", f"s{i % 3}") for i in range(30)] + [(7, "apple Ä", "a", "s1")] * 2
    rows += [(None, None, None, None), (50, "", "", "s0"), (51, "apple", "", None), (52, "12 34 _", "a", "empty"), (53, "zebra " * 200_000 + "apple", "a", "s2")]
    rows += [(60 + i, "only a few", "b", f"t{i}") for i in range(3)] + [(70, "alone", "c", "one")]
    rows += [(80 + i, f"tie{'x' * (i % 3)} common", "d", "u" if i % 2 else "v") for i in range(60)]
    check(spark, rows)


def test_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], COLUMNS)).collect() == []


def test_large_counts_stay_exact(spark):
    """Shares are exact where count times SCALE passes 64 bits."""
    n, total, v = 3 * 10**12 + 7, 9 * 10**13 + 1, 12345
    row = spark.range(1).select(divergence._share(*[divergence.F.lit(x) for x in (n, total, v)]).alias("p")).collect()[0]
    assert row["p"] == 1 + 10**9 * (n + 2) // (total + 2 * v)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_agrees_with_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    assert compare(divergence.source_divergence(spark.read.parquet(f"{sf}/documents.parquet")), connect(sf), divergence.ORACLE) is None
