"""Workflow, campaign and planning queries on the synthetic tables."""

from pyspark.sql import functions as F

from quarrylight.operators import workflow as W
from quarrylight.operators.intervals import overlap_groups as overlap_groups_of
from quarrylight.plans.relational import _RANK_SQL, ranked
from quarrylight.registry import register
from quarrylight.session import table

_STEPS = "s AS (SELECT l_orderkey AS run_id, l_linenumber AS position, CASE WHEN l_linestatus = 'F' THEN 'completed' WHEN l_returnflag = 'R' THEN 'running' ELSE 'pending' END AS status FROM lineitem), u AS (SELECT DISTINCT a.run_id, a.position FROM s a LEFT JOIN s b ON a.run_id = b.run_id AND b.position = a.position - 2 AND b.status = 'completed' WHERE a.position > 2 AND b.run_id IS NULL)"


def _steps(spark, sf_dir):
    status = F.when(F.col("l_linestatus") == "F", "completed").when(F.col("l_returnflag") == "R", "running").otherwise("pending")
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("position"), status.alias("status"))
    return s, s.filter("position > 2").select("run_id", "position", (F.col("position") - 2).alias("requires_position"))


@register("ready_batch", f"""WITH {_STEPS}, r AS (SELECT s.run_id, s.position, row_number() OVER (PARTITION BY s.run_id ORDER BY s.position) AS i FROM s ANTI JOIN u ON s.run_id = u.run_id AND s.position = u.position WHERE status = 'pending'),
b AS (SELECT run_id, count(*) FILTER (status = 'running') AS busy FROM s GROUP BY 1) SELECT r.run_id, r.position FROM r JOIN b USING (run_id) WHERE i <= 2 - busy""")  # fmt: skip
def ready_batch(spark, sf_dir):
    return W.ready_steps(*_steps(spark, sf_dir))


@register("dispatch_advice", f"""WITH {_STEPS}, g AS (SELECT s.run_id, count(*) FILTER (status = 'completed') AS completed, 0::BIGINT AS failed, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'pending' AND u.run_id IS NULL) AS ready, count(*) AS steps
FROM s LEFT JOIN u ON s.run_id = u.run_id AND s.position = u.position GROUP BY 1)
SELECT *, CASE WHEN completed = steps THEN 'terminal' WHEN failed > 0 THEN 'failed' WHEN running > 0 THEN 'running' WHEN ready > 0 THEN 'ready' ELSE 'blocked' END AS advice FROM g""")  # fmt: skip
def dispatch_advice(spark, sf_dir):
    return W.dispatch_advice(*_steps(spark, sf_dir))


@register("queue_head", "SELECT o_orderkey, count(*) OVER () AS waiting, count(*) OVER () > 8 AS over_depth FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def queue_head(spark, sf_dir):
    q = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"))
    return W.queue_head(q, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "waiting", "over_depth")


_FINDINGS = "f AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey * 10 + l_linenumber AS path, l_returnflag AS category, l_suppkey * 1000 + l_orderkey % 97 AS endpoint, l_orderkey % 400 AS lo, l_orderkey % 400 + l_quantity::BIGINT AS hi FROM lineitem)"


@register("finding_relationships", f"""WITH {_FINDINGS}, j AS (SELECT a.id AS left_id, b.id AS right_id, a.category AS ca, b.category AS cb, a.lo <= b.hi AND b.lo <= a.hi AS o FROM f a JOIN f b ON a.id < b.id AND a.path = b.path),
p AS (SELECT left_id, right_id, CASE WHEN ca = cb THEN 'SHARED_ROOT_CAUSE' WHEN o THEN 'SOURCE_OVERLAP' ELSE 'POTENTIAL_CONFLICT' END AS kind FROM j UNION ALL SELECT left_id, right_id, 'VALIDATION_DEPENDENCY' FROM j WHERE ca = 'A' OR cb = 'A'
UNION ALL SELECT a.id, b.id, 'RETEST_DEPENDENCY' FROM f a JOIN f b ON a.id < b.id AND a.endpoint = b.endpoint)
SELECT *, CASE kind WHEN 'SHARED_ROOT_CAUSE' THEN 0.92 WHEN 'SOURCE_OVERLAP' THEN 0.88 WHEN 'RETEST_DEPENDENCY' THEN 0.75 WHEN 'POTENTIAL_CONFLICT' THEN 0.72 ELSE 0.66 END::DOUBLE AS confidence FROM p""")  # fmt: skip
def finding_relationships(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    f = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("path"), F.col("l_returnflag").alias("category"), (F.col("l_suppkey") * 1000 + F.col("l_orderkey") % 97).alias("endpoint"), (F.col("l_orderkey") % 400).alias("lo"), (F.col("l_orderkey") % 400 + F.col("l_quantity").cast("long")).alias("hi"))
    return W.relationships(f, ["A"])


_CAMPAIGN = "f AS (SELECT l_orderkey * 10 + l_linenumber AS id, min(l_partkey) AS path, min(l_returnflag) AS category, min(l_suppkey) * 1000 + l_orderkey % 97 AS endpoint, l_orderkey % 400 AS lo, l_orderkey % 400 + max(l_quantity)::BIGINT AS hi FROM lineitem GROUP BY l_orderkey, l_linenumber)"
_ISLANDS = """isl AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY lo, hi, id) AS g FROM (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY path ORDER BY lo, hi, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM f)),
og AS (SELECT id, min(id) OVER (PARTITION BY path, g) AS group_id, count(*) OVER (PARTITION BY path, g) AS members FROM isl)"""


def _campaign(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("path"), F.min("l_returnflag").alias("category"), F.min("l_suppkey").alias("s"), F.max("l_quantity").alias("q"))
    lo = F.col("l_orderkey") % 400
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "path", "category", (F.col("s") * 1000 + F.col("l_orderkey") % 97).alias("endpoint"), lo.alias("lo"), (lo + F.col("q").cast("long")).alias("hi"))


@register("finding_relationship_groups", f"""WITH {_CAMPAIGN}, {_ISLANDS}, lead AS (SELECT path, category, min(id) AS lead FROM f GROUP BY 1, 2),
k AS (SELECT f.*, lead FROM f JOIN lead ON lead.path = f.path AND lead.category = f.category),
j AS (SELECT a.id AS x, b.id AS y, a.lo <= b.hi AND b.lo <= a.hi AS o, a.lead = b.lead AND (a.id = a.lead OR b.id = b.lead) AS s, a.category = 'A' OR b.category = 'A' AS v FROM k a JOIN k b ON a.path = b.path AND a.id <> b.id),
p AS (SELECT x AS id, unnest(list_filter([CASE WHEN s THEN 'SHARED_ROOT_CAUSE' END, CASE WHEN o THEN 'SOURCE_OVERLAP' WHEN NOT s THEN 'POTENTIAL_CONFLICT' END, CASE WHEN v THEN 'VALIDATION_DEPENDENCY' END], lambda t: t IS NOT NULL)) AS kind FROM j
  UNION ALL SELECT a.id, 'RETEST_DEPENDENCY' FROM f a JOIN f b ON a.endpoint = b.endpoint AND a.id <> b.id),
n AS (SELECT id, kind, count(*) AS links FROM p GROUP BY 1, 2),
c AS (SELECT id, min(id) OVER (PARTITION BY path) AS pg, count(*) OVER (PARTITION BY path) AS pn, min(id) OVER (PARTITION BY path, category) AS rg, count(*) OVER (PARTITION BY path, category) AS rn, min(id) OVER (PARTITION BY endpoint) AS eg, count(*) OVER (PARTITION BY endpoint) AS en FROM f)
SELECT n.id, kind, links, CASE kind WHEN 'SHARED_ROOT_CAUSE' THEN rg WHEN 'SOURCE_OVERLAP' THEN og.group_id WHEN 'RETEST_DEPENDENCY' THEN eg ELSE pg END AS group_id, CASE kind WHEN 'SHARED_ROOT_CAUSE' THEN rn WHEN 'SOURCE_OVERLAP' THEN og.members WHEN 'RETEST_DEPENDENCY' THEN en ELSE pn END AS members,
CASE kind WHEN 'SHARED_ROOT_CAUSE' THEN 0.92 WHEN 'SOURCE_OVERLAP' THEN 0.88 WHEN 'RETEST_DEPENDENCY' THEN 0.75 WHEN 'POTENTIAL_CONFLICT' THEN 0.72 ELSE 0.66 END::DOUBLE AS confidence FROM n JOIN c ON c.id = n.id JOIN og ON og.id = n.id""")  # fmt: skip
def finding_relationship_groups(spark, sf_dir):
    """Campaign classes without their pairs: each finding's representative, class size and own links by kind."""
    return W.relationship_groups(_campaign(spark, sf_dir), ["A"])


@register("overlap_groups", f"""WITH {_CAMPAIGN}, {_ISLANDS}, n AS (SELECT a.id, count(b.id) AS links FROM f a LEFT JOIN f b ON b.path = a.path AND b.id <> a.id AND b.lo <= a.hi AND a.lo <= b.hi GROUP BY 1)
SELECT path, f.id, lo, hi, group_id, members, links FROM f JOIN og ON og.id = f.id JOIN n ON n.id = f.id""")  # fmt: skip
def overlap_groups(spark, sf_dir):
    """Line ranges of a file that overlap, as groups: a sweep with a running maximum instead of the pairs."""
    return overlap_groups_of(_campaign(spark, sf_dir), ["path"], "id")


@register("risk_graph_edges", """SELECT DISTINCT user_id::VARCHAR AS source, event_type AS target, 'reaches' AS kind FROM events UNION SELECT DISTINCT event_type, event_id::VARCHAR, 'exposes' FROM events""")
def risk_graph_edges(spark, sf_dir):
    return W.risk_graph(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")[1]


@register("candidate_scores", """WITH c AS (SELECT o_orderkey AS finding_id, p_partkey AS candidate, l_quantity > 30 AS terminal, l_linenumber = 1 AS parent, l_discount > 0.05 AS parameter, p_size > 25 AS path, l_returnflag = 'N' AS method, l_tax > 0.04 AS exact, p_brand = 'Brand#11' AS language,
CASE WHEN o_orderpriority = '1-URGENT' THEN 0.9 END::DOUBLE AS route FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
s AS (SELECT finding_id, candidate, greatest(round(least(0.20::DOUBLE + CASE WHEN terminal THEN 0.28 ELSE 0 END + CASE WHEN parent THEN 0.16 ELSE 0 END + CASE WHEN parameter THEN 0.16 ELSE 0 END + CASE WHEN path THEN 0.10 ELSE 0 END + CASE WHEN method THEN 0.06 ELSE 0 END
+ CASE WHEN exact THEN 0.04 ELSE 0 END + CASE WHEN language THEN 0.02 ELSE 0 END, 0.94), 4), coalesce(route, 0)) AS score FROM c)
SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY score DESC, candidate) AS place FROM s WHERE score >= 0.38 QUALIFY place <= 8""")  # fmt: skip
def candidate_scores(spark, sf_dir):
    """Findings (orders) and the candidates that their lines name; evidence and routes come from the joined rows."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    j = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    evidence = {"terminal": F.col("l_quantity") > 30, "parent": F.col("l_linenumber") == 1, "parameter": F.col("l_discount") > 0.05, "path": F.col("p_size") > 25, "method": F.col("l_returnflag") == "N", "exact": F.col("l_tax") > 0.04, "language": F.col("p_brand") == "Brand#11"}
    route = F.when(F.col("o_orderpriority") == "1-URGENT", 0.9)
    return W.best_candidates(j.select(F.col("o_orderkey").alias("finding_id"), F.col("p_partkey").alias("candidate"), route.alias("route_confidence"), *[c.alias(n) for n, c in evidence.items()]))


@register("eligibility_decisions", """WITH e AS (SELECT o_orderkey, o_orderstatus = 'O' AS live, count(l_orderkey) AS evidence, max(1 - l_discount * 5) AS best, o_custkey % 10 = 0 AS alone, o_custkey % 4 AS c, o_totalprice > 100000 AS patch FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 20 GROUP BY ALL)
SELECT c, CASE WHEN NOT live OR evidence = 0 THEN 'INSUFFICIENT' WHEN alone OR best IS NULL THEN 'MANUAL' WHEN c = 1 THEN CASE WHEN best >= 0.55 THEN 'GUIDED' ELSE 'MANUAL' END WHEN patch AND best >= 0.82 THEN 'AUTO' WHEN best >= 0.58 AND c <> 2 THEN 'GUIDED' ELSE 'MANUAL' END AS decision, count(*) AS n FROM e GROUP BY 1, 2""")  # fmt: skip
def eligibility_decisions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 20").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("evidence"), F.max(1 - F.col("l_discount") * 5).alias("best"))
    o = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    category = F.element_at(F.array(*map(F.lit, ("xss", "cors", "timing", "sql_injection"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    decision = W.eligibility(F.col("o_orderstatus") == "O", F.col("evidence"), F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")), category, F.col("best"), F.col("o_totalprice") > 100000)
    return o.groupBy((F.col("o_custkey") % 4).alias("c"), decision.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@register("repair_rollup", """WITH c AS (SELECT l_orderkey AS repair_id, CASE WHEN p_type LIKE 'PROMO%' THEN 'missing' WHEN l_quantity > 45 THEN 'mismatch' ELSE 'matched' END AS s FROM lineitem JOIN part ON p_partkey = l_partkey),
g AS (SELECT repair_id, count(*) FILTER (s = 'matched') AS matched, count(*) FILTER (s = 'mismatch') AS mismatch, count(*) FILTER (s = 'missing') AS missing FROM c GROUP BY 1)
SELECT g.*, CASE WHEN missing > 0 THEN 'incomplete' WHEN mismatch > 0 THEN 'mismatch' WHEN o_orderstatus = 'O' THEN 'applied_finding_open' ELSE 'verified' END AS status FROM g JOIN orders ON o_orderkey = repair_id""")  # fmt: skip
def repair_rollup(spark, sf_dir):
    after = F.when(F.col("l_quantity") > 45, "old").otherwise("new")
    changes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("repair_id"), F.col("l_partkey").alias("path"), after.alias("after_hash"))
    current = table(spark, sf_dir, "part").filter("p_type NOT LIKE 'PROMO%'").select(F.col("p_partkey").alias("path"), F.lit("new").alias("content_hash"))
    return W.repair_rollup(changes, current, table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("repair_id")))


@register("before_after", """SELECT coalesce(b.user_id, a.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'resolved' WHEN b.user_id IS NULL THEN 'new' ELSE 'still_open' END AS outcome
FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-16') b FULL JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-16') a ON a.user_id = b.user_id""")  # fmt: skip
def before_after(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return W.before_after(e.filter("ts < TIMESTAMP '2024-01-16'"), e.filter("ts >= TIMESTAMP '2024-01-16'"), "user_id", ["ts", "event_id"])


@register("priority_plan", f"""WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus <> 'O'), {_RANK_SQL}, o_orderkey) AS ordinal FROM orders)
SELECT o_orderkey, ordinal, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY ordinal) AS depends_on FROM r""")  # fmt: skip
def priority_plan(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderstatus") != "O", ranked("o_orderpriority"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("ordinal"), F.lag("o_orderkey").over(w).alias("depends_on"))


@register("multi_finding_overlap", """WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS i FROM lineitem)
SELECT l_partkey, count(DISTINCT l_orderkey) AS findings FROM r WHERE i <= 3 GROUP BY 1 HAVING findings > 1""")  # fmt: skip
def multi_finding_overlap(spark, sf_dir):
    from quarrylight.operators.relational import top_per_key

    top = top_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_quantity"), F.col("l_linenumber"), F.col("l_partkey")], 3)
    return top.groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("findings")).filter("findings > 1")


@register("snapshot_digest", """WITH a AS (SELECT lang, doc_id // 4096 AS b, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS h FROM documents GROUP BY 1, 2),
c AS (SELECT lang, b // 4096 AS b, sha256(string_agg(h, chr(10) ORDER BY a.b)) AS h FROM a GROUP BY lang, a.b // 4096) SELECT lang, sha256(string_agg(h, chr(10) ORDER BY b)) AS digest FROM c GROUP BY 1""")  # fmt: skip
def snapshot_digest(spark, sf_dir):
    from quarrylight.operators.relational import block_digest

    return block_digest(table(spark, sf_dir, "documents"), "lang", "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2("text", 256)))


@register("run_history", "SELECT o_orderkey, o_orderstatus, coalesce(n, 0) AS findings, coalesce(q, 0) AS quantity FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def run_history(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    o = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100)
    return o.join(m, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0)).alias("findings"), F.coalesce("q", F.lit(0.0)).alias("quantity"))


@register("follow_up_roles", """SELECT DISTINCT conv_id, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) < 4) AND role <> 'user'""")
def follow_up_roles(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    short = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n < 4")
    return c.filter("role <> 'user'").join(short.select("conv_id"), "conv_id", "left_semi").select("conv_id", "role").distinct()
