import re

import pytest

from quarrylight.llm.licences import BASE_PHRASES, evaluate_expression, parse_expression, scan_licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    hits = []
    for phrase, label in BASE_PHRASES.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_columns(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    odd = [None, "", "MIT License", "the mit  license, mit-license Apache\nLICENSE; gnu general public license v3 mit license", "émit license mit licenseé",
           "mit license " * 5000, "MIT İ License", "[MIT] (license)"]
    rows += [(10_000 + i, t) for i, t in enumerate(odd)]
    got = {r["doc_id"]: r for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


@pytest.mark.parametrize(
    "text,verdict,ids",
    [("MIT", True, {"mit"}), ("MIT OR GPL-3.0-only", True, {"mit", "gpl-3.0-only"}), ("MIT AND GPL-2.0+", False, {"mit", "gpl-2.0+"}),
     ("GPL-2.0-only WITH Classpath-exception-2.0 OR (MIT AND ISC)", True, {"gpl-2.0-only", "mit", "isc"}), ("(A OR MIT) AND B", False, {"a", "mit", "b"})],
)
def test_expressions(text, verdict, ids):
    assert evaluate_expression(parse_expression(text)) == (verdict, ids)


@pytest.mark.parametrize("text", ["", "OR MIT", "(MIT", "MIT AND", "MIT)", "()"])
def test_bad_expressions(text):
    assert parse_expression(text) is None


def test_tagged(spark):
    df = spark.createDataFrame([(1, "// SPDX-License-Identifier: (MIT OR Apache-2.0)\ncode")], "doc_id long, text string")
    r = scan_licences(df).first()
    assert r["labels"] == "apache-2.0,mit" and r["base_labels"] == "" and r["permissive"]
