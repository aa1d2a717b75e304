"""Lifecycle, delta, interval, probe and graph queries."""

from pyspark.sql import functions as F

from quarrylight.operators import graph as G
from quarrylight.operators import joins as J
from quarrylight.operators import lifecycle as L
from quarrylight.plans.relational import _HALVES, halves
from quarrylight.registry import register
from quarrylight.session import table

_KEYS = ["user_id", "event_type"]
_MERGED = f"""WITH {_HALVES}, f AS (SELECT user_id, event_type, first_seen, CASE WHEN value > 50 THEN 'open' ELSE 'resolved' END AS status FROM old),
m AS (SELECT coalesce(f.user_id, n.user_id) AS user_id, coalesce(f.event_type, n.event_type) AS event_type, f.status AS was, f.first_seen, n.user_id IS NOT NULL AS seen, f.user_id IS NOT NULL AS known
  FROM f FULL JOIN new n ON f.user_id = n.user_id AND f.event_type = n.event_type),
c AS (SELECT *, CASE WHEN seen AND NOT known THEN 'opened' WHEN seen AND was <> 'open' THEN 'reopened' WHEN seen THEN 'refreshed' WHEN was = 'open' AND GATE THEN 'resolved' ELSE 'kept' END AS change FROM m) """


def merged(spark, sf_dir, gate=True):
    old, new = halves(spark, sf_dir)
    findings = old.select(*_KEYS, F.when(F.col("value") > 50, "open").otherwise("resolved").alias("status"), "first_seen", F.col("first_seen").alias("last_seen"))
    return L.merge_findings(findings, new, _KEYS, F.to_timestamp(F.lit("2024-02-01 00:00:00")), gate)


@register("lifecycle_snapshot", _MERGED.replace("GATE", "true") + """SELECT user_id, event_type, change, CASE WHEN seen THEN 'open' WHEN change = 'resolved' THEN 'resolved' ELSE was END AS status,
coalesce(first_seen, TIMESTAMP '2024-02-01') AS first_seen FROM c""")  # fmt: skip
def lifecycle_snapshot(spark, sf_dir):
    return merged(spark, sf_dir).drop("last_seen")


for _open_only, _name in ((True, "lifecycle_counts_open"), (False, "lifecycle_counts_all")):
    _sql = "SELECT count(*) FILTER (change IN (OPENED)) AS opened, count(*) FILTER (change IN (REFRESHED)) AS refreshed, count(*) FILTER (change = 'resolved') AS resolved FROM c"
    _sql = _sql.replace("OPENED", "'opened', 'reopened'" if _open_only else "'opened'").replace("REFRESHED", "'refreshed'" if _open_only else "'refreshed', 'reopened'")
    register(_name, _MERGED.replace("GATE", "true") + _sql)(lambda spark, sf_dir, o=_open_only: L.lifecycle_counts(merged(spark, sf_dir), o))


@register("coverage_gated_resolve", _MERGED.replace("GATE", "false") + "SELECT change, count(*) AS n FROM c GROUP BY 1")
def coverage_gated_resolve(spark, sf_dir):
    return merged(spark, sf_dir, False).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@register("snapshot_diff", f"""WITH {_HALVES} SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.event_type, n.event_type) AS event_type, o.value AS previous, n.value AS current,
CASE WHEN o.user_id IS NULL THEN 'new' WHEN n.user_id IS NULL THEN 'resolved' WHEN o.value IS DISTINCT FROM n.value THEN 'changed' ELSE 'persistent' END AS state
FROM old o FULL JOIN new n ON o.user_id = n.user_id AND o.event_type = n.event_type""")  # fmt: skip
def snapshot_diff(spark, sf_dir):
    return L.snapshot_diff(*halves(spark, sf_dir), _KEYS, "value")


_OLD_NEW = """WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang <> 'es'),
b AS (SELECT doc_id, CASE WHEN n_chars < 300 THEN sha256(text || 'x') ELSE sha256(text) END AS h FROM documents WHERE lang <> 'de')"""


def two_scans(spark, sf_dir):
    """Spanish documents are new in the second scan, German ones gone, short ones changed; every document is in one scan at least."""
    d = table(spark, sf_dir, "documents")
    changed = F.when(F.col("n_chars") < 300, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    return d.filter("lang <> 'es'").select("doc_id", F.sha2("text", 256).alias("h")), d.filter("lang <> 'de'").select("doc_id", changed.alias("h"))


@register("incremental_hash_delta", _OLD_NEW + """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS state
FROM a FULL JOIN b ON a.doc_id = b.doc_id""")  # fmt: skip
def incremental_hash_delta(spark, sf_dir):
    return L.index_delta(*two_scans(spark, sf_dir), "doc_id", "h")


@register("files_to_parse", _OLD_NEW + "SELECT b.doc_id, b.h FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id AND a.h = b.h)")
def files_to_parse(spark, sf_dir):
    old, new = two_scans(spark, sf_dir)
    return L.to_parse(new, old, ["doc_id", "h"])


@register("stale_relations", """SELECT l_orderkey, l_linenumber, l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AS is_active FROM lineitem""")
def stale_relations(spark, sf_dir):
    rel = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(True).alias("is_active"))
    return L.stale(rel, table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), "l_orderkey", "o_orderkey")


_SEMANTICS = """fi AS (SELECT doc_id AS id, doc_id % 10 = 0 OR doc_id % 17 = 0 AS hit FROM documents), sy AS (SELECT p_partkey AS id, p_partkey % 997 AS file, p_size = 50 AS gone FROM part),
re AS (SELECT l_orderkey * 10 + l_linenumber AS id, min(l_partkey) AS subject, min(l_suppkey) AS container, max(l_partkey) + 1 AS target, l_orderkey % 1009 AS occurrence, l_linenumber * 31 AS target_file, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey * 20 + l_linenumber END AS edge FROM lineitem GROUP BY l_orderkey, l_linenumber),
im AS (SELECT o_orderkey AS id, o_custkey % 997 AS source, o_orderkey % 997 AS target, -o_orderkey AS edge FROM orders),
li AS (SELECT 'file' AS fk, unnest([occurrence, target_file]) AS f, 'relation' AS tk, id AS t FROM re UNION ALL SELECT 'symbol', unnest([subject, container, target]), 'relation', id FROM re UNION ALL SELECT 'file', unnest([source, target]), 'import', id FROM im
  UNION ALL SELECT 'file', file, 'state', id FROM sy UNION ALL SELECT 'symbol', id, 'state', id FROM sy UNION ALL SELECT 'relation', id, 'edge', edge FROM re WHERE edge IS NOT NULL UNION ALL SELECT 'import', id, 'edge', edge FROM im)"""


@register("semantic_invalidation", f"""WITH RECURSIVE {_SEMANTICS}, w AS (SELECT 'file' AS kind, id FROM fi WHERE hit UNION SELECT 'symbol', id FROM sy WHERE gone UNION SELECT li.tk, li.t FROM w JOIN li ON li.fk = w.kind AND li.f = w.id)
SELECT DISTINCT kind, id FROM w WHERE kind NOT IN ('file', 'symbol')""")  # fmt: skip
def semantic_invalidation(spark, sf_dir):
    """What a new index of documents makes stale among relations (lineitem), imports (orders), states of symbols (part) and graph edges."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.lit("h").alias("old_hash"), F.when(F.col("doc_id") % 10 == 0, "n").otherwise("h").alias("new_hash"), F.lit(True).alias("was_active"), (F.col("doc_id") % 17 != 0).alias("is_active"))
    symbols = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), (F.col("p_partkey") % 997).alias("file_id"), F.lit(True).alias("was_active"), (F.col("p_size") != 50).alias("is_active"))
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("subject"), F.min("l_suppkey").alias("container"), (F.max("l_partkey") + 1).alias("target"))
    line, order = F.col("l_linenumber").cast("long"), F.col("l_orderkey")
    relations = li.select((order * 10 + line).alias("relation_id"), "subject", "container", "target", (order % 1009).alias("occurrence_file"), (line * 31).alias("target_file"), F.when(line % 2 == 0, order * 20 + line).alias("edge_id"))
    imports = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("import_id"), (F.col("o_custkey") % 997).alias("source_file"), (F.col("o_orderkey") % 997).alias("target_file"), (-F.col("o_orderkey")).alias("edge_id"))
    return L.invalidate_semantics(d, symbols, relations, imports).select("kind", "id")


@register("snapshot_changes", """SELECT lang, doc_id, CASE WHEN doc_id % 103 = 0 THEN 'added' WHEN doc_id % 101 = 0 THEN 'removed' ELSE 'changed' END AS state FROM documents WHERE (doc_id % 103 = 0) <> (doc_id % 101 = 0) OR (doc_id % 97 = 0 AND doc_id % 103 <> 0 AND doc_id % 101 <> 0)""")
def snapshot_changes(spark, sf_dir):
    """Two snapshots of documents by their digest trees: only rows of blocks that differ are compared."""
    from quarrylight.operators import relational as R

    d = table(spark, sf_dir, "documents").select("lang", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    old = d.filter("doc_id % 103 <> 0")
    new = d.filter("doc_id % 101 <> 0").withColumn("digest", F.when(F.col("doc_id") % 97 == 0, F.sha2("digest", 256)).otherwise(F.col("digest")))
    trees = [R.digest_tree(t, "lang", "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("digest")), 16) for t in (old, new)]
    return R.tree_changes(old, new, R.differing_blocks(*trees, "lang", 16), "lang", "doc_id", "digest", 16)


@register("state_transition_violations", """SELECT event_id, from_state, event_type AS to_state FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events)
WHERE from_state IS NOT NULL AND NOT ((from_state = 'view' AND event_type = 'click') OR (from_state = 'click' AND event_type = 'purchase') OR (from_state = 'signup' AND event_type = 'view'))""")  # fmt: skip
def state_transition_violations(spark, sf_dir):
    allowed = [("view", "click"), ("click", "purchase"), ("signup", "view")]
    return L.illegal_transitions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", allowed).select("event_id", "from_state", "to_state")


@register("domain_violations", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def domain_violations(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(~F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_orderstatus")


@register("orphan_rows", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def orphan_rows(spark, sf_dir):
    return L.orphans(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").filter("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey")


@register("single_active_violations", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS n FROM orders GROUP BY 1 HAVING n > 1")
def single_active_violations(spark, sf_dir):
    return L.over_limit(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "P", 1)


_SPANS = "s AS (SELECT l_suppkey * 10 + l_linenumber AS k, l_orderkey * 10 + l_linenumber AS id, (l_partkey % 900)::BIGINT AS lo, (l_partkey % 900 + l_quantity)::BIGINT AS hi FROM lineitem)"


def _spans(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 900).alias("lo"), (F.col("l_partkey") % 900 + F.col("l_quantity")).cast("long").alias("hi"))


@register("narrowest_containing_interval", f"""WITH {_SPANS}, p AS (SELECT l_suppkey * 10 + l_linenumber AS k, l_orderkey * 10 + l_linenumber AS point_id, (l_partkey % 900 + 2)::BIGINT AS at FROM lineitem),
j AS (SELECT p.k, point_id, id, hi - lo AS width, lo FROM p JOIN s ON p.k = s.k AND lo <= at AND at <= hi),
r AS (SELECT *, row_number() OVER (PARTITION BY k, point_id ORDER BY width, lo DESC, id) AS i, min(id) OVER (PARTITION BY k, point_id, width) = max(id) OVER (PARTITION BY k, point_id, width) AS uniq FROM j)
SELECT k, point_id, id, width, uniq AS "unique" FROM r WHERE i = 1""".replace(" AS at ", " AS spot ").replace("lo <= at AND at <= hi", "lo <= spot AND spot <= hi"))  # fmt: skip
def narrowest_containing_interval(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    at = F.col("l_partkey") % 900 + 2
    points = li.select((F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), at.alias("start"), at.alias("stop"))
    return J.narrowest_container(points, _spans(spark, sf_dir), ["k"], "point_id", "id")


@register("overlap_pairs", f"WITH {_SPANS} SELECT a.k, a.id AS left_id, b.id AS right_id FROM s a JOIN s b ON a.k = b.k AND a.id < b.id AND a.lo <= b.hi AND b.lo <= a.hi")
def overlap_pairs(spark, sf_dir):
    return J.overlaps(_spans(spark, sf_dir), ["k"], "id")


@register("structural_parent", f"""WITH {_SPANS}, r AS (SELECT a.k, a.id, b.id AS parent_id, row_number() OVER (PARTITION BY a.k, a.id ORDER BY b.hi - b.lo NULLS LAST, b.id) AS i
FROM s a LEFT JOIN s b ON a.k = b.k AND b.lo <= a.lo AND a.hi <= b.hi AND b.hi - b.lo > a.hi - a.lo) SELECT k, id, parent_id FROM r WHERE i = 1""")  # fmt: skip
def structural_parent(spark, sf_dir):
    return J.structural_parent(_spans(spark, sf_dir), ["k"], "id")


@register("first_candidate_probe", """WITH c AS (SELECT page_id, unnest([split_part(url, '/', 4), split_part(url, '/', 3), 'en']) AS t, unnest([0, 1, 2]) AS place FROM pages),
r AS (SELECT c.*, row_number() OVER (PARTITION BY page_id ORDER BY place) AS i FROM c WHERE t IN ('fr', 'de', 'en')) SELECT p.page_id, r.t AS target, r.place FROM pages p LEFT JOIN r ON r.page_id = p.page_id AND i = 1""")  # fmt: skip
def first_candidate_probe(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.array(F.split_part("url", F.lit("/"), F.lit(4)), F.split_part("url", F.lit("/"), F.lit(3)), F.lit("en")).alias("c"))
    return J.first_match(p, spark.createDataFrame([("fr",), ("de",), ("en",)], "target string"), "page_id", "c", "target")


@register("uniqueness_gated_resolution", """WITH n AS (SELECT p_name, count(*) AS n, min(p_partkey) AS t FROM part WHERE p_size < 20 GROUP BY 1)
SELECT p.p_partkey AS ref_id, CASE WHEN n.n IS NULL THEN 'unresolved' WHEN n.n = 1 THEN 'resolved' ELSE 'ambiguous' END AS state, CASE WHEN n.n = 1 THEN t END AS target FROM part p LEFT JOIN n USING (p_name)""")  # fmt: skip
def uniqueness_gated_resolution(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return J.resolve_unique(part.select(F.col("p_partkey").alias("ref_id"), "p_name"), part.filter("p_size < 20").select("p_name", F.col("p_partkey").alias("target")), ["p_name"], "ref_id", "target")


_ROUTES = [(1, "GET", "/en/:id"), (2, "GET", "/{lang}/:id"), (3, "GET", "/en/7198"), (4, "POST", "/en/:id"), (5, "GET", "/<a>/<b>/<c>")]


@register("template_join", """WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages)
SELECT page_id, CASE WHEN s = ['en', '7198'] THEN 3 WHEN len(s) = 2 AND s[1] = 'en' THEN 1 WHEN len(s) = 2 THEN 2 ELSE 5 END::BIGINT AS template_id, s = ['en', '7198'] AS exact FROM p WHERE len(s) IN (2, 3)""")  # fmt: skip
def template_join(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("GET").alias("method"), F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1).alias("path"))
    return J.template_join(pages, spark.createDataFrame(_ROUTES, "template_id long, method string, template string"), "page_id", "template_id")


# ---- graphs over the whole part table: each part points at one of 211 parts, which gives tails and cycles

_EDGES = "e AS (SELECT DISTINCT p_partkey AS source, (p_partkey * 7 + p_size) % 211 AS target FROM part)"


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), ((F.col("p_partkey") * 7 + F.col("p_size")) % 211).alias("target")).distinct()


@register("impact_bfs", f"""WITH RECURSIVE {_EDGES}, w AS (SELECT 5::BIGINT AS node, 0 AS depth UNION SELECT e.source, w.depth + 1 FROM w JOIN e ON e.target = w.node WHERE w.depth < 8),
d AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1), v AS (SELECT d.node, d.depth, min(e.target) AS via FROM d JOIN e ON e.source = d.node JOIN d u ON u.node = e.target AND u.depth = d.depth - 1 GROUP BY 1, 2)
SELECT node, depth, via FROM v WHERE depth > 0""")  # fmt: skip
def impact_bfs(spark, sf_dir):
    return G.impact(_edges(spark, sf_dir), spark.createDataFrame([(5,)], "node long"), 8)


@register("scc_cycles", f"""WITH RECURSIVE {_EDGES}, r AS (SELECT source, target FROM e UNION SELECT r.source, e.target FROM r JOIN e ON r.target = e.source)
SELECT a.source AS node, min(a.target) AS component FROM r a JOIN r b ON a.source = b.target AND a.target = b.source GROUP BY 1""")  # fmt: skip
def scc_cycles(spark, sf_dir):
    return G.strongly_connected(_edges(spark, sf_dir))


_DAG = "n AS (SELECT p_partkey AS node FROM part), e AS (SELECT p_partkey AS source, p_partkey // (2 + p_size % 3) AS target FROM part WHERE p_partkey // (2 + p_size % 3) > 0)"


@register("kahn_levels", f"""WITH RECURSIVE {_DAG}, w AS (SELECT node, 0 AS level FROM n UNION SELECT e.source, w.level + 1 FROM w JOIN e ON e.target = w.node)
SELECT node, max(level) AS level FROM w GROUP BY 1""")  # fmt: skip
def kahn_levels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    target = F.floor(F.col("p_partkey") / (2 + F.col("p_size") % 3))
    return G.kahn_levels(p.select(F.col("p_partkey").alias("node")), p.select(F.col("p_partkey").alias("source"), target.alias("target")).filter("target > 0"))


@register("nesting_depth", """WITH RECURSIVE p AS (SELECT p_partkey AS node, CASE WHEN p_partkey // 3 > 0 THEN p_partkey // 3 END AS parent FROM part),
w AS (SELECT node, parent, 0 AS depth FROM p UNION ALL SELECT w.node, p.parent, w.depth + 1 FROM w JOIN p ON p.node = w.parent) SELECT node, max(depth) AS depth FROM w GROUP BY 1""")  # fmt: skip
def nesting_depth(spark, sf_dir):
    up = F.floor(F.col("p_partkey") / 3)
    return G.ancestor_depth(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(up > 0, up).alias("parent")))


@register("graph_summary", """SELECT (SELECT count(*) FROM (SELECT DISTINCT l_partkey FROM lineitem)) + (SELECT count(*) FROM (SELECT DISTINCT l_suppkey FROM lineitem)) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS edges""")
def graph_summary(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return e.agg((F.countDistinct("l_partkey") + F.countDistinct("l_suppkey")).alias("nodes"), F.count(F.lit(1)).alias("edges"))


@register("neighbourhood", "SELECT DISTINCT 'supplies' AS relationship, l_suppkey AS node FROM lineitem WHERE l_partkey = 42 UNION SELECT DISTINCT 'ordered_in', l_orderkey FROM lineitem WHERE l_partkey = 42 ORDER BY 1, 2 LIMIT 200")
def neighbourhood(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_partkey = 42")
    both = li.select(F.lit("supplies").alias("relationship"), F.col("l_suppkey").alias("node")).union(li.select(F.lit("ordered_in"), "l_orderkey")).distinct()
    return both.orderBy("relationship", "node").limit(200)


@register("event_transition_graph", """SELECT source, target, count(*) AS evidence, count(DISTINCT user_id) AS users FROM (SELECT user_id, event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) WHERE target IS NOT NULL GROUP BY 1, 2""")
def event_transition_graph(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("target", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("target IS NOT NULL")
    return e.groupBy(F.col("event_type").alias("source"), "target").agg(F.count(F.lit(1)).alias("evidence"), F.countDistinct("user_id").alias("users"))


@register("orphan_nodes", "SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def orphan_nodes(spark, sf_dir):
    return L.orphans(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")), table(spark, sf_dir, "lineitem").filter("l_quantity > 40"), "node", "l_partkey")
