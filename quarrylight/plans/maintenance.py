"""Lifecycle, integrity, import and graph queries beyond the basic ones, over the synthetic tables."""

from pyspark.sql import functions as F

from quarrylight.operators import graph as G
from quarrylight.operators import integrity as I
from quarrylight.operators import lifecycle as L
from quarrylight.operators import secrets
from quarrylight.registry import register
from quarrylight.session import table

# ------------------------------------------------------------------ receipts, digests, audit

_STEP = "s AS (SELECT conv_id AS run_id, turn AS position, role, 'completed' AS status, text AS result FROM conversations)"
_RECEIPTS = """r AS (SELECT conv_id AS run_id, turn AS position, CASE WHEN conv_id % 11 = 3 AND turn = 1 THEN 'other' ELSE role END AS role, 'completed' AS status, sha256(CASE WHEN conv_id % 7 = 2 AND turn = 0 THEN text || '!' ELSE text END) AS result_sha256
FROM conversations WHERE NOT (conv_id % 13 = 5 AND turn = 1))"""
_CHECK = f"""{_STEP}, {_RECEIPTS}, c AS (SELECT s.run_id, count(*) FILTER (NOT coalesce(s.role = r.role AND s.result <> '' AND sha256(s.result) = r.result_sha256, false)) AS problems
FROM s LEFT JOIN (SELECT run_id, position, min(role) AS role, min(result_sha256) AS result_sha256 FROM r GROUP BY 1, 2 HAVING count(*) = 1) r ON s.run_id = r.run_id AND s.position = r.position GROUP BY 1)"""


def _receipts(spark, sf_dir):
    """Conversations as runs: receipts of some runs have another role, an edited result, or are missing."""
    c = table(spark, sf_dir, "conversations")
    steps = c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("position"), "role", F.lit("completed").alias("status"), F.col("text").alias("result"))
    odd = lambda n, r, turn: (F.col("run_id") % n == r) & (F.col("position") == turn)
    issued = steps.filter(~odd(13, 5, 1)).select(
        "run_id", "position", F.when(odd(11, 3, 1), "other").otherwise(F.col("role")).alias("role"), "status",
        F.sha2(F.when(odd(7, 2, 0), F.concat("result", F.lit("!"))).otherwise(F.col("result")), 256).alias("result_sha256"),
    )
    return steps, issued


@register("step_digest_verify", f"WITH {_CHECK} SELECT run_id, problems = 0 AS verified, problems FROM c")
def step_digest_verify(spark, sf_dir):
    return I.receipt_check(*_receipts(spark, sf_dir))


@register("audit_page", f"""WITH {_CHECK}, p AS (SELECT run_id, problems = 0 AS verified, row_number() OVER (ORDER BY run_id DESC) AS i FROM c)
SELECT (SELECT count(*) FROM c) AS total_completed, count(*) FILTER (i <= 20) AS checked, count(*) FILTER (i <= 20 AND verified) AS verified, count(*) FILTER (i <= 20 AND NOT verified) AS invalid,
CASE WHEN max(i) > 20 THEN min(run_id) FILTER (i <= 20) END AS next_before FROM p WHERE i <= 21""")  # fmt: skip
def audit_page(spark, sf_dir):
    steps, receipts = _receipts(spark, sf_dir)
    runs = steps.select("run_id").distinct().withColumn("rowid", F.col("run_id"))
    return I.audit_page(runs, I.receipt_check(steps, receipts), 20)


@register("stored_digest_gate", """WITH b AS (SELECT event_id, user_id, props AS body, sha256(CASE WHEN event_id % 50 = 1 THEN props || ' ' ELSE props END) AS digest, CASE WHEN event_id % 30 = 2 THEN -1 ELSE (props->>'$.k')::BIGINT END AS k FROM events)
SELECT event_id, coalesce(sha256(body) = digest AND k::VARCHAR IS NOT DISTINCT FROM body->>'$.k', false) AS valid FROM b""")  # fmt: skip
def stored_digest_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stored = F.sha2(F.when(F.col("event_id") % 50 == 1, F.concat("props", F.lit(" "))).otherwise(F.col("props")), 256)
    k = F.when(F.col("event_id") % 30 == 2, F.lit(-1)).otherwise(F.get_json_object("props", "$.k").cast("long"))
    rows = e.select("event_id", F.col("props").alias("body"), stored.alias("digest"), k.alias("k"))
    return I.digest_gate(rows, "body", "digest", {"k": "$.k"}).select("event_id", "valid")


@register("rewritten_rows", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'removed' ELSE 'changed' END AS problem FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT'""")
def rewritten_rows(spark, sf_dir):
    before = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return I.rewritten(before, before.filter("o_orderstatus <> 'P'").withColumn("o_totalprice", price), "o_orderkey", ["o_totalprice", "o_orderdate", "o_custkey"])


@register("unproven_fixes", """WITH a AS (SELECT o_orderkey AS attempt_id, o_custkey AS finding_id, o_orderpriority AS p, o_orderkey AS floor FROM orders WHERE o_orderstatus = 'F'),
t AS (SELECT o_custkey AS finding_id, max(o_orderkey) AS passed FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') GROUP BY 1), r AS (SELECT DISTINCT l_orderkey AS attempt_id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)
SELECT a.attempt_id, CASE WHEN p = '5-LOW' THEN 'retest_state' WHEN p = '2-HIGH' THEN 'no_application' WHEN NOT coalesce(passed > floor, false) THEN 'no_fresh_retest' WHEN r.attempt_id IS NOT NULL THEN 'regression' END AS problem
FROM a LEFT JOIN t USING (finding_id) LEFT JOIN r USING (attempt_id) WHERE problem IS NOT NULL""")  # fmt: skip
def unproven_fixes(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    p = F.col("o_orderpriority")
    attempts = o.select(
        F.col("o_orderkey").alias("attempt_id"), F.col("o_custkey").alias("finding_id"), F.when(F.col("o_orderstatus") == "F", "fix_verified").otherwise("applied").alias("status"),
        F.when(p == "5-LOW", "PENDING").otherwise("FIX_VERIFIED").alias("retest_state"), F.when(p == "2-HIGH", None).otherwise(F.col("o_orderkey")).alias("application_run_id"), F.col("o_orderkey").alias("retest_floor"),
    )
    retests = o.select(F.col("o_custkey").alias("finding_id"), F.when(p.isin("1-URGENT", "3-MEDIUM"), "retest_passed").otherwise("still_vulnerable").alias("status"), F.col("o_orderkey").alias("rowid"))
    results = li.select(F.col("l_orderkey").alias("attempt_id"), F.when(F.col("l_quantity") > 40, "FAIL").otherwise("PASS").alias("status"), F.when(F.col("l_returnflag") == "R", "UNKNOWN").otherwise("PRE_EXISTING").alias("classification"))
    return I.unproven(attempts, retests, results)


@register("overflow_guard", "SELECT least(count(*), 101) AS n, count(*) > 100 AS overflow FROM orders")
def overflow_guard(spark, sf_dir):
    return I.over_rows(table(spark, sf_dir, "orders"), 100)


# ------------------------------------------------------------------ lifecycles

_REVIEW = "f AS (SELECT o_orderkey AS finding_id, o_orderstatus AS s, o_custkey % 5 AS run, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey % 3 END AS last_run, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS h FROM orders)"


@register("review_currency", f"""WITH {_REVIEW}, r AS (SELECT l_orderkey * 10 + l_linenumber AS review_id, l_orderkey AS finding_id, l_partkey % 3 AS scan_run, CASE WHEN l_returnflag = 'A' THEN NULL ELSE '3-MEDIUM' END AS h FROM lineitem)
SELECT review_id, r.finding_id, coalesce(s = 'O' AND scan_run = coalesce(last_run, run) AND r.h IS NOT DISTINCT FROM f.h, false) AS "current" FROM r LEFT JOIN f USING (finding_id)""")  # fmt: skip
def review_currency(spark, sf_dir):
    o, p = table(spark, sf_dir, "orders"), F.col("o_orderpriority")
    findings = o.select(F.col("o_orderkey").alias("finding_id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("resolved").alias("status"), (F.col("o_custkey") % 5).alias("run"),
                        F.when(p == "5-LOW", None).otherwise(F.col("o_custkey") % 3).alias("last_run"), F.when(p == "1-URGENT", None).otherwise(p).alias("content_hash"))
    reviews = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("review_id"), F.col("l_orderkey").alias("finding_id"), (F.col("l_partkey") % 3).alias("scan_run"),
                                                      F.when(F.col("l_returnflag") == "A", None).otherwise(F.lit("3-MEDIUM")).alias("content_hash"))
    return L.current_reviews(reviews, findings)


_RETEST = "CASE l_returnflag WHEN 'A' THEN 'retest_passed' WHEN 'R' THEN 'still_vulnerable' ELSE 'running' END"


@register("retest_transitions", f"""WITH k AS (SELECT l_orderkey AS finding_id, min(struct_pack(rowid := l_linenumber, status := {_RETEST})).status AS result FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1)
SELECT o_orderkey AS finding_id, CASE WHEN o_orderstatus = 'F' AND result IS NOT NULL THEN result WHEN o_orderstatus = 'F' THEN 'fix_applied' ELSE 'open' END AS state, o_orderstatus = 'F' AND result IS NOT NULL AS transitioned FROM orders LEFT JOIN k ON finding_id = o_orderkey""")  # fmt: skip
def retest_transitions(spark, sf_dir):
    life = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id"), F.when(F.col("o_orderstatus") == "F", "fix_applied").otherwise("open").alias("state"))
    result = F.when(F.col("l_returnflag") == "A", "retest_passed").when(F.col("l_returnflag") == "R", "still_vulnerable").otherwise("running")
    return L.apply_retests(life, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding_id"), F.col("l_linenumber").alias("rowid"), result.alias("status")))


@register("without_fresh_retest", """SELECT o_orderkey AS finding_id, o_custkey AS ordinal FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey % 2 = o_custkey % 2 AND l_linenumber > 3)""")
def without_fresh_retest(spark, sf_dir):
    findings = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id"), (F.col("o_custkey") % 2).alias("session_id"), F.col("o_custkey").alias("ordinal"))
    return L.without_fresh_retest(findings, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding_id"), (F.col("l_suppkey") % 2).alias("session_id"), F.col("l_linenumber").alias("rowid")), 3)


@register("evidence_replaced", """WITH n AS (SELECT o_orderkey AS finding, 0 AS place, 'ev:' || sha256('ev'::BLOB || unhex(lpad(printf('%x', strlen(o_orderkey::VARCHAR)), 16, '0')) || encode(o_orderkey::VARCHAR)) AS id FROM orders WHERE o_orderstatus = 'F')
SELECT l_orderkey AS finding, l_linenumber AS place, l_orderkey || '-' || l_linenumber AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT finding FROM n) UNION ALL SELECT finding, place, id FROM n""")  # fmt: skip
def evidence_replaced(spark, sf_dir):
    from quarrylight.functions.scalar import deterministic_id

    old = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding"), F.col("l_linenumber").alias("place"), F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias("id"))
    new = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("finding"), F.lit(0).alias("place"))
    return L.replace_children(old, new, "finding", deterministic_id("ev", F.col("finding").cast("string")))


@register("symbol_delta", """WITH a AS (SELECT p_partkey, p_size, p_brand FROM part WHERE p_type NOT LIKE 'PROMO%'), b AS (SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN p_size + 1 ELSE p_size END AS p_size, p_brand FROM part WHERE p_type NOT LIKE 'ECONOMY%')
SELECT coalesce(a.p_partkey, b.p_partkey) AS fingerprint, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' WHEN a.p_size = b.p_size THEN 'unchanged' ELSE 'updated' END AS state FROM a FULL JOIN b ON a.p_partkey = b.p_partkey""")  # fmt: skip
def symbol_delta(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    shape = lambda size: [F.col("p_partkey").alias("fingerprint"), size.alias("start_line"), (size + 10).alias("end_line"), F.col("p_brand").alias("signature"), F.lit(None).cast("long").alias("parent")]
    moved = F.when(F.col("p_brand") == "Brand#11", F.col("p_size") + 1).otherwise(F.col("p_size"))
    return L.symbol_delta(part.filter("p_type NOT LIKE 'PROMO%'").select(*shape(F.col("p_size"))), part.filter("p_type NOT LIKE 'ECONOMY%'").select(*shape(moved)))


def _index(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id"))
    symbols = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("symbol_id"), (F.col("p_partkey") % 10 + 1).alias("file_id"))
    imports = li.select((F.col("l_partkey") % 10 + 1).alias("source_file"), F.when(F.col("l_linenumber") < 3, F.col("l_suppkey")).alias("target_file"))
    calls = li.filter("l_linenumber = 1").select(F.concat(F.lit("p"), "l_partkey").alias("source_symbol"), F.concat(F.lit("p"), "l_suppkey").alias("target_symbol"))
    before = spark.createDataFrame([("file", "1"), ("file", "gone")], "kind string, id string")
    return L.materialise_graph("main", files, symbols, imports, calls, before)


@register("graph_nodes", """SELECT 'project' AS kind, 'main' AS id, true AS is_active UNION ALL SELECT 'file', s_suppkey::VARCHAR, true FROM supplier UNION ALL SELECT 'symbol', 'p' || p_partkey, true FROM part UNION ALL SELECT 'file', 'gone', false""")
def graph_nodes(spark, sf_dir):
    return _index(spark, sf_dir)[0]


@register("graph_edges", """SELECT 'contains' AS kind, 'main' AS source, s_suppkey::VARCHAR AS target FROM supplier UNION SELECT 'defines', (p_partkey % 10 + 1)::VARCHAR, 'p' || p_partkey FROM part
UNION SELECT 'imports', (l_partkey % 10 + 1)::VARCHAR, l_suppkey::VARCHAR FROM lineitem WHERE l_linenumber < 3 UNION SELECT 'calls', 'p' || l_partkey, 'p' || l_suppkey FROM lineitem WHERE l_linenumber = 1""")  # fmt: skip
def graph_edges(spark, sf_dir):
    return _index(spark, sf_dir)[1]


@register("interrupted_steps", """SELECT l_orderkey AS job_id, l_linenumber AS position, CASE WHEN o_orderstatus = 'P' AND l_linestatus = 'O' THEN 'interrupted' WHEN l_linestatus = 'O' THEN 'pending' ELSE 'completed' END AS status FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""")
def interrupted_steps(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("planned").alias("status"))
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("position"), F.when(F.col("l_linestatus") == "O", "pending").otherwise("completed").alias("status"))
    return L.recover_interrupted(jobs, steps)[1]


# ------------------------------------------------------------------ imports


@register("import_self_join", """SELECT DISTINCT a.l_suppkey AS source, b.l_suppkey AS target FROM lineitem i JOIN lineitem a ON a.l_orderkey = i.l_orderkey AND a.l_linenumber = i.l_linenumber JOIN lineitem b ON b.l_orderkey = i.l_orderkey AND b.l_linenumber = i.l_linenumber + 1 WHERE a.l_linestatus = b.l_linestatus""")
def import_self_join(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus")
    target = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("target"), F.col("l_linestatus").alias("_s"))
    return li.join(target, ["l_orderkey", "l_linenumber"]).filter("l_linestatus = _s").select(F.col("l_suppkey").alias("source"), "target").distinct()


# ------------------------------------------------------------------ graphs

def _tails(spark, sf_dir):
    """Chains of fifty parts; in every other block of fifty the chain's upper end runs in a cycle of seven, with a tail behind it."""
    k = F.col("p_partkey")
    parent = F.when(k % 50 == 0, None).otherwise(k - 1)
    return table(spark, sf_dir, "part").select(k.alias("node"), F.when(k % 100 == 1, k + 6).otherwise(parent).alias("parent"))


@register("nesting_depth_cycles", """WITH b AS (SELECT p_partkey AS node, p_partkey % 50 AS i, p_partkey % 100 < 50 AS odd FROM part)
SELECT node, CASE WHEN odd AND i = 0 THEN 0 WHEN odd AND i BETWEEN 1 AND 7 THEN 7 ELSE i END AS depth FROM b""")  # fmt: skip
def nesting_depth_cycles(spark, sf_dir):
    return G.ancestor_depth(_tails(spark, sf_dir))


@register("nesting_depth_deep", "SELECT p_partkey AS node, p_partkey AS depth FROM part")
def nesting_depth_deep(spark, sf_dir):
    k = F.col("p_partkey")
    return G.ancestor_depth(table(spark, sf_dir, "part").select(k.alias("node"), F.when(k > 0, k - 1).alias("parent")))


@register("shortest_paths", """WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS source, p_partkey // (2 + p_size % 3) AS target FROM part WHERE p_partkey // (2 + p_size % 3) > 0),
w AS (SELECT p_partkey AS node, 0 AS depth FROM part WHERE p_size = 50 UNION SELECT e.target, w.depth + 1 FROM w JOIN e ON e.source = w.node) SELECT node, min(depth) AS depth FROM w GROUP BY 1""")  # fmt: skip
def shortest_paths(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    target = F.floor(F.col("p_partkey") / (2 + F.col("p_size") % 3))
    return G.shortest_paths(p.select(F.col("p_partkey").alias("source"), target.alias("target")).filter("target > 0"), p.filter("p_size = 50").select(F.col("p_partkey").alias("node"))).select("node", "depth")


_FOREST = """e AS (SELECT CASE WHEN p_partkey % 40 = 7 THEN p_partkey + 1 WHEN p_partkey % 40 = 8 THEN p_partkey - 1 ELSE p_partkey // (2 + p_size % 3) END AS source, p_partkey AS target FROM part), f AS (SELECT e.source, e.target FROM e JOIN part ON p_partkey = e.source)"""


@register("graph_inference", f"""WITH RECURSIVE {_FOREST}, dn AS (SELECT 3::BIGINT AS node, [3::BIGINT] AS path UNION ALL SELECT f.target, list_append(dn.path, f.target) FROM dn JOIN f ON f.source = dn.node WHERE NOT list_contains(dn.path, f.target)),
up AS (SELECT 3::BIGINT AS node, [3::BIGINT] AS path UNION ALL SELECT f.source, list_append(up.path, f.source) FROM up JOIN f ON f.target = up.node WHERE NOT list_contains(up.path, f.source)),
ok AS (SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT target FROM f) UNION SELECT f.target FROM ok JOIN f ON f.source = ok.node)
SELECT 'descendant' AS relation, node, array_to_string(path, '>') AS path FROM dn WHERE node <> 3 UNION ALL SELECT 'ancestor', node, array_to_string(path, '>') FROM up WHERE node <> 3
UNION ALL SELECT 'orphan', p_partkey, NULL FROM part WHERE p_partkey NOT IN (SELECT node FROM ok) UNION ALL SELECT 'cyclic', a.source, NULL FROM f a JOIN f b ON b.source = a.target AND b.target = a.source""")  # fmt: skip
def graph_inference(spark, sf_dir):
    """What part 3 leads to and comes from in a forest of parts with rings, and what no root leads to."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    source = F.when(key % 40 == 7, key + 1).when(key % 40 == 8, key - 1).otherwise(F.floor(key / (2 + F.col("p_size") % 3)))
    nodes = p.select(key.alias("node"))
    edges = p.select(source.alias("source"), key.alias("target")).join(nodes.withColumnRenamed("node", "source"), "source", "left_semi")
    return G.inference(nodes, edges, 3).select("relation", "node", F.array_join("path", ">").alias("path"))


_LATTICE = "e AS (SELECT DISTINCT s AS source, unnest([s // 2, s // 3, s // 5]) AS target FROM (SELECT p_partkey AS s, p_size FROM part) WHERE p_size % 4 <> 0), f AS (SELECT * FROM e WHERE target > 0)"


@register("all_shortest_paths", f"""WITH RECURSIVE {_LATTICE}, w AS (SELECT p_partkey AS node, 0 AS depth, [p_partkey] AS path FROM part WHERE p_partkey % 500 = 1 UNION ALL SELECT f.target, w.depth + 1, list_append(w.path, f.target) FROM w JOIN f ON f.source = w.node),
m AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1), s AS (SELECT DISTINCT w.node, w.depth, w.path FROM w JOIN m ON m.node = w.node AND m.depth = w.depth),
r AS (SELECT *, count(*) OVER (PARTITION BY node) AS paths, row_number() OVER (PARTITION BY node ORDER BY path) AS place FROM s) SELECT node, depth, paths::DOUBLE AS paths, place, array_to_string(path, '>') AS path FROM r WHERE place <= 3""")  # fmt: skip
def all_shortest_paths(spark, sf_dir):
    """Every shortest path down a lattice of parts, from the parts behind every 500th: counted, the first three of each node written out."""
    p = table(spark, sf_dir, "part")
    s = F.col("p_partkey")
    edges = p.filter("p_size % 4 <> 0").select(s.alias("source"), F.explode(F.array(*[F.floor(s / k) for k in (2, 3, 5)])).alias("target")).filter("target > 0")
    found = G.all_shortest_paths(edges, p.filter("p_partkey % 500 = 1").select(s.alias("node")), 3)
    return found.select("node", "depth", F.col("paths").cast("double").alias("paths"), "place", F.array_join("path", ">").alias("path"))


@register("dependencies_and_dependents", """SELECT DISTINCT 'depends_on' AS relation, l_suppkey AS node FROM lineitem WHERE l_partkey = 7 UNION SELECT DISTINCT 'depended_on_by', l_partkey FROM lineitem WHERE l_suppkey = 7""")
def dependencies_and_dependents(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = li.filter("l_partkey = 7").select(F.lit("depends_on").alias("relation"), F.col("l_suppkey").alias("node"))
    return out.union(li.filter("l_suppkey = 7").select(F.lit("depended_on_by"), "l_partkey")).distinct()


# ------------------------------------------------------------------ secrets

_KEYS = "k AS (SELECT c_custkey, md5('k' || c_custkey) AS v, c_custkey % 4 = 0 AS test FROM customer)"


@register("secret_scan", f"""WITH {_KEYS}, h AS (SELECT *, 'AKIA' || upper(v[1:16]) AS aws, v[1:20] AS tok FROM k)
SELECT CASE WHEN test THEN 'tests/' ELSE 'src/' END || c_custkey || '.py' AS path, 'secret.aws_access_key_id' AS rule, 2::BIGINT AS line, CASE WHEN test THEN 0.57 ELSE 0.95 END::DOUBLE AS confidence, 'AKIA…' || upper(v[15:16]) AS redacted, test AS in_tests FROM h
UNION ALL SELECT CASE WHEN test THEN 'tests/' ELSE 'src/' END || c_custkey || '.py', 'secret.gitlab_token', 3::BIGINT, CASE WHEN test THEN 0.58 ELSE 0.96 END::DOUBLE, 'glpa…' || v[19:20], test FROM h""")  # fmt: skip
def secret_scan(spark, sf_dir):
    """A source text per customer with two tokens, one of them named like a generic credential, and two lines that must not match."""
    v = F.md5(F.concat(F.lit("k"), "c_custkey").cast("binary"))
    path = F.concat(F.when(F.col("c_custkey") % 4 == 0, "tests/").otherwise("src/"), "c_custkey", F.lit(".py"))
    text = F.concat(F.lit("import os\nid = "), F.concat(F.lit("AKIA"), F.upper(F.substring(v, 1, 16))), F.lit('\napi_key = "glpat-'), F.substring(v, 1, 20), F.lit('"\npassword = "changeme123"\nmail = "'), "c_name", F.lit('"\n'))
    return secrets.scan_secrets(table(spark, sf_dir, "customer").select(path.alias("path"), text.alias("text")))


@register("secret_scan_documents", "SELECT doc_id::VARCHAR AS path, 'none' AS rule FROM documents WHERE regexp_matches(text, 'AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|-----BEGIN [A-Z ]*PRIVATE KEY-----')")
def secret_scan_documents(spark, sf_dir):
    """Every document's text; the tables' own bare tokens are no secrets of any rule, so this shows the cost and no false alarms."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")).select("path", "rule")


@register("secret_history", """WITH a AS (SELECT sha256(l_suppkey::VARCHAR) AS value_hash, l_orderkey AS "commit", l_shipdate AS t, l_partkey AS path, l_suppkey FROM lineitem),
p AS (SELECT value_hash, list_sort(list(path))[1:20] AS paths FROM (SELECT DISTINCT value_hash, path::VARCHAR AS path FROM a) GROUP BY 1)
SELECT a.value_hash, min(struct_pack(t := t, c := "commit")).c AS introduced, count(DISTINCT "commit") AS commits, any_value(paths) AS paths, any_value(l_suppkey) IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50) AS present FROM a JOIN p USING (value_hash) GROUP BY 1, l_suppkey""")  # fmt: skip
def secret_history(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    added = li.select(F.col("l_orderkey").alias("commit"), F.col("l_shipdate").alias("time"), F.col("l_partkey").cast("string").alias("path"), F.col("l_suppkey").cast("string").alias("value"))
    return secrets.secret_history(added, li.filter("l_quantity = 50").select(F.col("l_suppkey").cast("string").alias("value")))
