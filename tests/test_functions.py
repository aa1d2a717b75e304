import pytest
from pyspark.sql import functions as F

from quarrylight.functions import html as H
from quarrylight.functions import scalar as S
from quarrylight.operators import secrets
from quarrylight.operators.advisories import ADVISORY_SCHEMA, bill_of_materials, match_advisories


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_paths(spark):
    cases = {"a/./b/../c": "a/c", "a\\b": "a/b", "../x": None, "a/../../b": None, "/abs": None, "C:/x": None, "": "", "a//b": "a/b"}
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", S.normalize_path(F.col("x")).alias("y"))
    assert {r["x"]: r["y"] for r in df.collect()} == cases


def test_versions_are_ordered(spark):
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-beta", "1.0-rc10", "1.0-rc2", "1.0", "1.0.1", "1.2", "1.10", "v2", "18446744073709551999.1"]
    df = spark.createDataFrame([(v,) for v in order], "v string").orderBy(S.version_key(F.col("v")))
    assert [r["v"] for r in df.collect()] == order
    same = spark.createDataFrame([("1.0", "1"), ("v1.0+build", "1.0.0"), ("1.0.Final", "1.0"), ("1.0.SP1", "1.0")], "a string, b string")
    assert all(r[0] for r in same.select(S.version_key(F.col("a")) == S.version_key(F.col("b"))).collect())


@pytest.mark.parametrize("vector,score", [("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0),
    ("CVSS:3.1/AV:L/AC:H/PR:H/UI:R/S:U/C:L/I:N/A:N", 1.8), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1), ("CVSS:3.0/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", 0.0), ("CVSS:2.0/AV:N", None), ("CVSS:3.1/AV:N", None)])
def test_cvss(spark, vector, score):
    assert one(spark, vector, S.cvss3_base_score) == score


def test_advisories(spark):
    rng = lambda *e, kind="SEMVER": (kind, list(e))
    rows = [
        ("A", None, [(("npm", "left"), [], [rng(("introduced", "1.0"), ("fixed", "1.5"), ("introduced", "2.0"), ("last_affected", "2.3"))])]),
        ("B", None, [(("PyPI", "My_Pkg"), ["0.9"], [])]), ("C", "2024", [(("npm", "left"), ["1.2"], [])]), ("D", None, [(("Debian:11", "left"), ["1.2"], [])]),
        ("E", None, [(("npm", "left"), [], [rng(("introduced", "0"), kind="GIT")])]),
    ]
    inv = [("npm", "left", v) for v in ("0.9", "1.2", "1.5", "2.3", "2.4", "1.5-rc1")] + [("PyPI", "my-pkg", "0.9")]
    got = match_advisories(spark.createDataFrame(inv, "ecosystem string, name string, version string"), spark.createDataFrame(rows, ADVISORY_SCHEMA)).collect()
    assert {(r["version"], r["advisory"], r["basis"]) for r in got} == {("1.2", "A", "range"), ("2.3", "A", "range"), ("1.5-rc1", "A", "range"), ("0.9", "B", "exact_version")}


def test_bill_of_materials(spark):
    inv = spark.createDataFrame([("npm", "@a/b", "1.0", True, "x"), ("npm", "@a/b", "1.0", False, "y"), ("PyPI", "A_b", "2", True, "z")], "ecosystem string, name string, version string, is_dev boolean, manifest_path string")
    got = {r["purl"]: r["scope"] for r in bill_of_materials(inv).collect()}
    assert got == {"pkg:npm/%40a/b@1.0": "required", "pkg:pypi/a-b@2": "optional"}


def test_secrets_by_place(spark):
    """A value that also stands earlier in its match, two matches of one rule, and an overlap that an earlier rule wins."""
    token = "ghp_" + "a1B2" * 9
    texts = [('password = "q9Zr7Lk2Xv8Tn4", pwd = "w8Yq6Kj1Wu7Sm3"', 2), (f'api_key="{token}"', 1), (f"{token} {token}", 2), (None, 0)]
    df = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(texts)], "path string, text string")
    got = [r["path"] for r in secrets.scan_secrets(df).collect()]
    assert [got.count(str(i)) for i in range(len(texts))] == [n for _, n in texts]


def test_html(spark):
    page = "<a href='/x#y'>1</a><a href='z.html'></a><img src=//c.d/i.png><a href='mailto:q'></a><form action='/s' method=post><input type=hidden name=csrf_token><input name=q></form><form method=post><input name=w></form>"
    df = spark.createDataFrame([(page, "https://a.b/p/q.html?x=1")], "html string, url string")
    r = df.select(H.links(F.col("html"), F.col("url")).alias("l")).first()
    assert r["l"] == ["https://a.b/p/z.html", "https://a.b/s", "https://a.b/x", "https://c.d/i.png"]


def test_responses(spark):
    df = spark.createDataFrame([(500, {"content-type": "text/html", "server": "x/1.2"}, ["sid=1; HttpOnly"], "Traceback (most", "https://a")], "status int, headers map<string,string>, cookies array<string>, body string, url string")
    got = set(df.select(H.response_findings(*[F.col(c) for c in ("status", "headers", "cookies", "body", "url")])).first()[0])
    assert {"missing_hsts", "cookie_without_secure", "verbose_error", "server_version"} <= got and "cookie_without_httponly" not in got


def test_softmax_labels_and_more(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], "Not-Vulnerable", "CWE-089, cwe_79 CWE 89", "nginx", 0)], "l array<double>, lab string, cwe string, img string, t long")
    r = df.select(S.softmax(F.col("l")).alias("s"), S.parse_label(F.col("lab")).alias("b"), S.parse_cwes(F.col("cwe")).alias("c"), S.image_is_mutable(F.col("img")).alias("m"), S.rfc3339(F.col("t")).alias("d"), S.join_routes(F.lit("/api/"), F.lit("//x/")).alias("j")).first()
    assert abs(sum(r["s"]) - 1) < 1e-9 and r["b"] is False and r["c"] == ["CWE-79", "CWE-89"] and r["m"] and r["d"] == "1970-01-01T00:00:00Z" and r["j"] == "/api/x"
