"""Queries over whole tables still meet every kind of case that they once met in made rows."""

import re

from quarrylight import registry
from quarrylight.operators.rules import FRAMEWORKS
from quarrylight.sources.repository import PARSERS

SF = "/root/testdata/sf0.001"


def test_urls_without_path_with_other_ports_and_no_urls(spark):
    got = [r["result"] for r in registry.QUERIES["urls_normalized"](spark, SF).collect()]
    assert None in got and any(":8080/" in u for u in got if u) and any(re.fullmatch("http://[^/]+/", u) for u in got if u) and any("/?x=" in u for u in got if u)


def test_a_role_without_a_column_is_an_error(spark):
    assert ("parts", "error") in {(r["table"], r["role"]) for r in registry.QUERIES["columns_resolved"](spark, SF).collect()}


def test_every_framework_is_found(spark):
    got = registry.QUERIES["test_frameworks_found"](spark, SF).collect()
    assert {r["framework"] for r in got} == {*FRAMEWORKS, "python_unknown", "javascript_unknown", "java_unknown"} and {r["evidence"] for r in got} == {"test", "config"}


def test_every_kind_of_manifest_is_parsed(spark):
    files = {r["manifest_path"].split("/")[1] for r in registry.QUERIES["lock_files_parsed"](spark, SF).collect()}
    assert [k for k in PARSERS if not any(re.fullmatch(k, f) for f in files)] == []
