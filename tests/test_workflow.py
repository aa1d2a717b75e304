from quarrylight.operators import graph as G
from quarrylight.operators import lifecycle as L
from quarrylight.operators import relational as R
from quarrylight.operators import workflow as W
from quarrylight.sources.sinks import report, write_components


ROUTE = "route_id int, file string, framework string, router string, router_prefix string, template string"
MOUNT = "source_file string, target_file string, framework string, parent_router string, imported_name string, binding string, prefix string, override boolean"


def mounted(spark, routes, mounts):
    r = spark.createDataFrame([(i, f, "x", "r", p, t) for i, f, p, t in routes], ROUTE)
    m = spark.createDataFrame([(up, at, kind, "r", name, "b", prefix, over) for at, up, kind, name, prefix, over in mounts], MOUNT)
    return {tuple(x) for x in W.expand_mounts(r, m).collect()}


def test_mounts(spark):
    """Two parents, a route alone, a circle, another framework, another name, and a prefix that overrides."""
    mounts = [("users", "api", "x", "r", "/users", False), ("api", "app", "x", "default", "/api/v1", None), ("users", "admin", "x", "*", "/admin/", True), ("loop", "back", "x", "r", "/b", False), ("back", "loop", "x", "r", "/c", False), ("lone", "z", "y", "r", "/no", False), ("lone", "z", "x", "q", "/no", False)]
    got = mounted(spark, [(1, "users", "/pre", "/pre/:id"), (2, "lone", None, "x/"), (3, "loop", "", "/l")], mounts)
    assert got == {(1, "/api/v1/users/pre/:id"), (1, "/admin/:id"), (2, "/x"), (3, "/c/b/l")}


def test_a_long_chain_of_mounts_keeps_its_route(spark):
    for n, want in ((7, 7), (8, 8), (9, 8), (12, 8)):
        got = mounted(spark, [(1, "f0", None, "/end")], [(f"f{i}", f"f{i + 1}", "x", "r", f"/p{i}", False) for i in range(n)])
        assert got == {(1, "".join(f"/p{i}" for i in reversed(range(want))) + "/end")}


def test_eligibility(spark):
    from pyspark.sql import functions as F

    rows = [(True, 2, 1, "xss", 0.4, True, "MANUAL"), (True, 2, 1, "xss", None, True, "MANUAL"), (True, 0, 1, "xss", 0.9, True, "INSUFFICIENT"), (False, 3, 1, "xss", 0.9, True, "INSUFFICIENT"), (True, 1, None, "xss", 0.9, True, "MANUAL"), (True, 1, 1, "xss", 0.9, False, "GUIDED"),
            (True, 1, 1, "xss", 0.82, True, "AUTO"), (True, 1, 1, "odd", 0.7, False, "MANUAL"), (True, 1, 1, "odd", 0.9, True, "AUTO"), (True, 1, 1, "cors", 0.9, True, "GUIDED"), (True, 1, 1, "cors", 0.5, True, "MANUAL"), (True, 1, 1, "xss", 0.56, True, "MANUAL"), (True, 1, 1, None, 0.6, None, "MANUAL")]
    df = spark.createDataFrame(rows, "o boolean, e int, p int, c string, b double, x boolean, want string")
    assert df.select(W.eligibility(*[F.col(c) for c in "oepcbx"]).alias("got"), "want").filter("got <> want").count() == 0


def test_follow_ups(spark):
    runs = spark.createDataFrame([(1, "failed"), (2, "interrupted"), (3, "completed"), (4, "failed"), (5, "failed"), (6, "failed")], "run_id int, status string")
    done = lambda r, *states: [(r, i, ("scout", "source", "deps", "web")[i], s) for i, s in enumerate(states)]
    steps = done(1, "completed", "failed", "skipped") + done(2, "completed", "completed", "completed", "interrupted") + done(3, "completed", "failed") + done(4, "completed", "completed", "completed") + done(5, "completed", "completed", "running") + [(6, 0, "source", "failed"), (6, 1, "scout", "failed")]
    got = [(r["run_id"], r["role"], r["depends_on"]) for r in W.follow_up(runs, spark.createDataFrame(steps, "run_id int, position int, role string, status string")).orderBy("run_id", "position").collect()]
    assert got == [(1, "scout", None), (1, "source", "scout"), (2, "scout", None), (2, "source", "scout"), (2, "web", "source")]


def test_plan(spark):
    e = spark.createDataFrame([("u", "get", {"id": ["query"], "b": ["query", "body"]}), ("u", "DELETE", {"id": ["path"]})], "url string, method string, parameters map<string,array<string>>")
    c = spark.createDataFrame([("sqli", ["query", "path"])], "category string, locations array<string>")
    assert sorted((r["method"], r["parameter"], r["risk"], r["selected"]) for r in W.test_plan(e, c).collect()) == [("DELETE", "id", "restricted", False), ("GET", "id", "safe", True)]


def test_lifecycle_reopens_and_gates(spark):
    from pyspark.sql import functions as F

    old = spark.createDataFrame([(1, "open"), (2, "open"), (3, "resolved")], "k int, status string").withColumns({"first_seen": F.to_timestamp(F.lit("2024-01-01")), "last_seen": F.to_timestamp(F.lit("2024-01-01"))})
    seen = spark.createDataFrame([(1,), (3,), (4,), (4,)], "k int")
    for gate, want in ((True, {1: "refreshed", 2: "resolved", 3: "reopened", 4: "opened"}), (False, {1: "refreshed", 2: "kept", 3: "reopened", 4: "opened"})):
        m = L.merge_findings(old, seen, ["k"], F.current_timestamp(), gate)
        assert {r["k"]: r["change"] for r in m.collect()} == want
    assert L.lifecycle_counts(m, True).first()["opened"] == 2 and L.lifecycle_counts(m, False).first()["opened"] == 1


def test_impact_limit_and_cycles(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a"), ("a", "c"), ("x", "x"), ("y", "x")], "source string, target string")
    got = [tuple(r) for r in G.impact(e, spark.createDataFrame([("a",)], "node string"), 8, 2).orderBy("depth", "node").collect()]
    assert got == [("b", 1, "a", True), ("d", 1, "a", True)]
    assert {tuple(r) for r in G.strongly_connected(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x")}
    nodes = spark.createDataFrame([(c,) for c in "abcdxy"], "node string")
    assert {r["node"]: r["level"] for r in G.kahn_levels(nodes, e).collect()}["d"] is None


def test_levels_of_a_deep_chain(spark):
    n = 104
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node int").coalesce(1)
    e = spark.createDataFrame([(i, i - 1) for i in range(1, n)], "source int, target int").coalesce(1)
    assert {r["node"]: r["level"] for r in G.kahn_levels(nodes, e).collect()} == {i: i for i in range(n)}


def test_cycles_that_take_a_pass_each(spark):
    """Cycle i reaches every later one, so all have one colour until it is taken."""
    n = 62
    edges = [(2 * i, 2 * j) for i in range(n) for j in range(i + 1, n)] + [p for i in range(n) for p in ((2 * i, 2 * i + 1), (2 * i + 1, 2 * i))]
    got = {tuple(r) for r in G.strongly_connected(spark.createDataFrame(edges, "source int, target int").coalesce(1)).collect()}
    assert got == {(2 * i + k, 2 * i) for i in range(n) for k in (0, 1)}


def test_depth_on_cycles_and_dangling_parents(spark):
    """A tail into a cycle counts the way and the cycle once; a parent that isn't there counts as one step."""
    p = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, None), (5, 4), (6, 99), (7, 7)], "node int, parent int")
    assert {r["node"]: r["depth"] for r in G.ancestor_depth(p).collect()} == {1: 3, 2: 2, 3: 2, 4: 0, 5: 1, 6: 1, 7: 1}


def test_report_and_pages(spark, tmp_path):
    out = report({"t": spark.createDataFrame([(1, "a|b"), (2, "<x>")], "n int, s string")})
    assert '"s": "a|b"' in out["json"] and "a\\|b" in out["md"] and "&lt;x&gt;" in out["html"]
    write_components(spark.createDataFrame([("{}",)], "component string"), str(tmp_path / "bom"))
    assert spark.read.text(str(tmp_path / "bom")).count() == 1
    page = R.keyset_page(spark.range(10), "id", None, 20).collect()
    assert len(page) == 10 and not page[0]["has_more"] and page[0]["next_cursor"] is None


def test_mounts_go_along_as_numbers(spark, monkeypatch):
    """Mounts are written once, each with a number; what a path went through is numbers, not texts."""
    written, settle = [], W.settle
    monkeypatch.setattr(W, "settle", lambda df, *more: written.append(settle(df, *more)) or written[-1])
    mounts = [("a", "b", "x", "r", "/m", False), ("a", "b", "x", "r", "/m", False), ("b", "a", "x", "r", "/n", None)]
    assert mounted(spark, [(1, "b", None, "/t")], mounts) == {(1, "/m/n/t")}
    assert written[0].count() == 2 and written[1].schema["seen"].dataType.simpleString() == "array<bigint>"
