"""Search, listing, paging, feed and rollup queries."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylight.operators import relational as R
from quarrylight.registry import register
from quarrylight.session import table

_RANK = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}


def ranked(column):
    return reduce(lambda w, kv: w.when(F.col(column) == kv[0], kv[1]), _RANK.items(), F.when(F.lit(False), 0)).otherwise(5)


_RANK_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _RANK.items()) + " ELSE 5 END"


@register("filter_optional", "SELECT event_id, user_id, value FROM events WHERE event_type = 'error'")
def filter_optional(spark, sf_dir):
    return R.where_given(table(spark, sf_dir, "events"), event_type="error", user_id=None).select("event_id", "user_id", "value")


@register("search_modes", """SELECT 'exact' AS mode, count(*) AS n FROM customer WHERE c_name = 'Customer#000000001'
UNION ALL SELECT 'prefix', count(*) FROM customer WHERE c_name ILIKE 'customer#00000001%' ESCAPE '\\'
UNION ALL SELECT 'substring', count(*) FROM customer WHERE c_name ILIKE '%R#%7%' ESCAPE '\\' AND contains(lower(c_name), 'r#')""")  # fmt: skip
def search_modes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    parts = [("exact", R.matches(F.col("c_name"), "Customer#000000001", "exact")), ("prefix", R.matches(F.col("c_name"), "customer#00000001", "prefix")),
             ("substring", R.matches(F.col("c_name"), "r#", "substring") & F.lower("c_name").rlike("r#.*7"))]
    return reduce(lambda a, b: a.unionByName(b), [c.agg(F.lit(m).alias("mode"), F.count_if(p).alias("n")) for m, p in parts])


@register("search_escaped", "SELECT doc_id FROM documents WHERE contains(text, '%%%') OR contains(text, '$_')")
def search_escaped(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").filter(text.like("%" + R.escape_like("%%%") + "%") | text.like("%" + R.escape_like("$_") + "%")).select("doc_id")


@register("contains_ignoring_case", "SELECT page_id FROM pages WHERE instr(lower(url), lower('EXAMPLE.NET')) > 0")
def contains_ignoring_case(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(F.contains(F.lower("url"), F.lower(F.lit("EXAMPLE.NET")))).select("page_id")


@register("clamped_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def clamped_limit(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(R.clamp(5000, 100))


@register("fenced_star_join", """SELECT n.n_name, r.r_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey
JOIN nation n ON s_nationkey = n_nationkey AND c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey
WHERE o_orderstatus = 'F' AND l_linestatus = 'F' GROUP BY 1, 2""")  # fmt: skip
def fenced_star_join(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").filter("l_linestatus = 'F'").join(t("orders").filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    j = j.join(t("nation"), (F.col("s_nationkey") == F.col("n_nationkey")) & (F.col("c_nationkey") == F.col("n_nationkey"))).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@register("null_safe_match", """SELECT count(*) AS n FROM (SELECT event_id, nullif(event_type, 'click') AS t FROM events) a
JOIN (SELECT event_id, nullif(event_type, 'view') AS u FROM events) b ON a.event_id = b.event_id AND a.t IS NOT DISTINCT FROM b.u""")  # fmt: skip
def null_safe_match(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a, b = e.select("event_id", F.expr("nullif(event_type, 'click')").alias("t")), e.select("event_id", F.expr("nullif(event_type, 'view')").alias("u"))
    return a.join(b, "event_id").filter(F.col("t").eqNullSafe(F.col("u"))).agg(F.count(F.lit(1)).alias("n"))


@register("json_path", "SELECT event_type, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k_sum, count(json_extract(props, '$.missing')) AS missing FROM events GROUP BY 1")
def json_path(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"), F.count(F.get_json_object("props", "$.missing")).alias("missing"))


@register("semi_anti_counts", """SELECT (SELECT count(*) FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS with_orders,
(SELECT count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS without_orders""")  # fmt: skip
def semi_anti_counts(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    has = c.join(o.distinct().withColumn("has", F.lit(True)), "c_custkey", "left")
    return has.agg(F.count_if("has").alias("with_orders"), F.count_if(F.col("has").isNull()).alias("without_orders"))


@register("not_in_baseline", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def not_in_baseline(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return R.not_in(o, "o_custkey", o.filter("o_orderstatus = 'P'")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@register("not_in_with_nulls", """SELECT (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT nullif(c_custkey, 7) FROM customer WHERE c_acctbal < 0)) AS with_null,
(SELECT count(*) FROM orders WHERE nullif(o_custkey, 7) NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) AS null_left, (SELECT count(*) FROM orders WHERE nullif(o_custkey, 7) NOT IN (SELECT c_custkey FROM customer WHERE c_custkey < 0)) AS none_right""")  # fmt: skip
def not_in_with_nulls(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders").select("o_custkey"), table(spark, sf_dir, "customer")
    blank = o.select(F.nullif("o_custkey", F.lit(7)).alias("o_custkey"))
    poor = c.filter("c_acctbal < 0")
    parts = {"with_null": R.not_in(o, "o_custkey", poor.select(F.nullif("c_custkey", F.lit(7)).alias("o_custkey"))), "null_left": R.not_in(blank, "o_custkey", poor.select(F.col("c_custkey").alias("o_custkey"))),
             "none_right": R.not_in(blank, "o_custkey", c.filter("c_custkey < 0").select(F.col("c_custkey").alias("o_custkey")))}
    counts = [d.agg(F.count(F.lit(1)).alias(n)) for n, d in parts.items()]
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))


@register("earliest_per_fingerprint", "SELECT user_id, event_type, min(struct_pack(ts := ts, id := event_id)).id AS event_id FROM events GROUP BY 1, 2")
def earliest_per_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"))


@register("all_dependencies_complete", """SELECT o_orderkey FROM orders WHERE NOT EXISTS
(SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus IS DISTINCT FROM 'F')""")  # fmt: skip
def all_dependencies_complete(spark, sf_dir):
    from quarrylight.operators.joins import dependencies_done

    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").eqNullSafe("F").alias("done"))
    return dependencies_done(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", "done")


@register("framework_counts", """SELECT p_brand, count(*) AS n, count(*) FILTER (p_size > 25) AS large, count(*) FILTER (p_type LIKE '%STEEL%') AS steel FROM part GROUP BY 1""")
def framework_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") > 25).alias("large"), F.count_if(F.col("p_type").contains("STEEL")).alias("steel"))


@register("severity_histogram", f"SELECT {_RANK_SQL} AS severity_rank, count(*) AS n FROM orders GROUP BY 1")
def severity_histogram(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(ranked("o_orderpriority").alias("severity_rank")).agg(F.count(F.lit(1)).alias("n"))


@register("guarded_append", "SELECT user_id, max(event_id) + 1 AS next_seq FROM events GROUP BY 1 HAVING coalesce(max(event_id), 0) + 1 <= 9900")
def guarded_append(spark, sf_dir):
    return R.guarded_append(table(spark, sf_dir, "events"), "user_id", "event_id", 9900)


@register("ordered_concat", "SELECT conv_id, string_agg(role, chr(31) ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def ordered_concat(spark, sf_dir):
    steps = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(steps["role"], "\x1f").alias("roles"))


@register("fan_out_suppliers", """WITH f AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS fan_out FROM lineitem GROUP BY 1)
SELECT l_partkey, fan_out, CASE WHEN fan_out >= 40 THEN 'medium' ELSE 'low' END AS severity FROM f WHERE fan_out >= 20""")  # fmt: skip
def fan_out_suppliers(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("fan_out")).filter("fan_out >= 20")
    return f.withColumn("severity", F.when(F.col("fan_out") >= 40, "medium").otherwise("low"))


@register("evidence_sets", """SELECT l_partkey % 50 AS grp, count(*) AS evidence, array_to_string(list_sort(list(DISTINCT l_returnflag || l_linestatus)), ',') AS providers FROM lineitem GROUP BY 1""")
def evidence_sets(spark, sf_dir):
    providers = F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), ",")
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 50).alias("grp")).agg(F.count(F.lit(1)).alias("evidence"), providers.alias("providers"))


@register("all_dev", "SELECT p_brand, bool_and(p_size > 2) AS is_dev, count(*) AS n FROM part GROUP BY 1")
def all_dev(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.bool_and(F.col("p_size") > 2).alias("is_dev"), F.count(F.lit(1)).alias("n"))


@register("debt_rollup", " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 2" for c in ("l_returnflag", "l_linestatus")))
def debt_rollup(spark, sf_dir):
    pair = lambda c: F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value"))
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", F.explode(F.array(pair("l_returnflag"), pair("l_linestatus"))).alias("d"))
    return rows.groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@register("state_pivot", """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def state_pivot(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


@register("scorecard_percent", """SELECT c_nationkey, count(o_orderkey) AS mapped, count(*) FILTER (o_orderstatus = 'F') AS tested,
CASE WHEN count(o_orderkey) = 0 THEN 0.0::DOUBLE ELSE round(1000.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / count(o_orderkey)) / 10 END AS coverage_percent
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")  # fmt: skip
def scorecard_percent(spark, sf_dir):
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    g = j.groupBy("c_nationkey").agg(F.count("o_orderkey").alias("mapped"), F.count_if(F.col("o_orderstatus") == "F").alias("tested"))
    percent = F.round(1000.0 * F.col("tested") / F.when(F.col("mapped") > 0, F.col("mapped"))) / 10
    return g.withColumn("coverage_percent", F.coalesce(percent, F.lit(0.0)))


@register("merge_by_priority", """SELECT user_id, min(event_id) AS depth, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds,
arg_min(value, event_id) FILTER (value IS NOT NULL) AS first_value, max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END) AS priority FROM events GROUP BY 1""")  # fmt: skip
def merge_by_priority(spark, sf_dir):
    rank = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).otherwise(1)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min("event_id").alias("depth"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"),
        F.min(F.when(F.col("value").isNotNull(), F.struct("event_id", "value")))["value"].alias("first_value"), F.max(rank).alias("priority"),
    )


@register("finding_dedup", f"""WITH r AS (SELECT o_custkey, {_RANK_SQL} AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)
SELECT o_custkey, min(k) AS severity_rank, string_agg(o_orderkey, ',' ORDER BY o_orderkey) FILTER (i <= 8) AS evidence FROM r GROUP BY 1""")  # fmt: skip
def finding_dedup(spark, sf_dir):
    """Only the eight of a key that are kept are gathered."""
    o = table(spark, sf_dir, "orders")
    worst = o.groupBy("o_custkey").agg(F.min(ranked("o_orderpriority")).alias("severity_rank"))
    kept = R.top_per_key(o.select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")], 8).groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("e"))
    return worst.join(kept, "o_custkey").select("o_custkey", "severity_rank", F.array_join(F.col("e").cast("array<string>"), ",").alias("evidence"))


@register("project_overview", """SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers,
(SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey) AS segments,
(SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS orders FROM nation""")  # fmt: skip
def project_overview(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    per = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.countDistinct("c_mktsegment").alias("segments"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n")).join(c, "c_custkey").groupBy("c_nationkey").agg(F.sum("n").alias("orders"))
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey").join(per, "c_nationkey", "left").join(orders, "c_nationkey", "left")
    return n.select("n_name", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("customers", "segments", "orders")])


@register("occurrence_ordinal", "SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) - 1 AS ordinal FROM documents")
def occurrence_ordinal(spark, sf_dir):
    w = Window.partitionBy("_h").orderBy("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("_h")).select("doc_id", (F.row_number().over(w) - 1).alias("ordinal"))


@register("latest_run_per_kind", "SELECT event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def latest_run_per_kind(spark, sf_dir):
    return R.latest_per_key(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), ["event_type"], ["event_id"])


@register("retention_top_n", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i <= 20")
def retention_top_n(spark, sf_dir):
    return R.top_per_key(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


@register("sequence_numbers", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def sequence_numbers(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"))


@register("first_detected", "SELECT event_id, min(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS first_detected FROM events")
def first_detected(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.min("ts").over(w).alias("first_detected"))


@register("search_per_group", """SELECT kind, id, name FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY name, id) AS i FROM (
SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'part', p_partkey, p_name FROM part
UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier) WHERE name ILIKE '%1%') WHERE i <= 5""")  # fmt: skip
def search_per_group(spark, sf_dir):
    kinds = [("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name")]
    rows = [table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(i).alias("id"), F.col(n).alias("name")) for t, i, n in kinds]
    found = reduce(lambda a, b: a.unionByName(b), rows).filter(R.matches(F.col("name"), "1", "substring"))
    return R.top_per_key(found, ["kind"], [F.col("name"), F.col("id")], 5)


@register("sliding_error_window", """SELECT event_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) AS errors FROM events""")
def sliding_error_window(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-40, -1)
    return table(spark, sf_dir, "events").select("event_id", F.count(F.when(F.col("event_type") == "error", 1)).over(w).alias("errors"))


@register("header_propagation", """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM events""")
def header_propagation(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("header"))


@register("handoff_lead", "SELECT * FROM (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) WHERE next_role IS NOT NULL")
def handoff_lead(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("next_role")).filter("next_role IS NOT NULL")


@register("priority_listing", f"SELECT o_orderkey, {_RANK_SQL} AS severity_rank FROM orders ORDER BY {_RANK_SQL}, (o_orderstatus = 'O') DESC, o_orderdate DESC, o_orderkey LIMIT 50")
def priority_listing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("severity_rank", ranked("o_orderpriority"))
    return o.orderBy("severity_rank", (F.col("o_orderstatus") == "O").desc(), F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "severity_rank")


@register("keyset_page", """WITH p AS (SELECT event_id, event_type FROM events WHERE event_id < 5000 ORDER BY event_id DESC LIMIT 26),
q AS (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS i, count(*) OVER () > 25 AS has_more FROM p)
SELECT event_id, event_type, has_more, CASE WHEN has_more THEN (min(event_id) OVER ())::VARCHAR END AS next_cursor FROM q WHERE i <= 25""")  # fmt: skip
def keyset_page(spark, sf_dir):
    return R.keyset_page(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 5000, 25)


@register("top_25", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 25")
def top_25(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(25)


@register("activity_feed", """SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS seen_at FROM orders UNION ALL SELECT 'event', event_id, ts FROM events) ORDER BY seen_at DESC, kind, id LIMIT 40""")
def activity_feed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("seen_at"))
    e = table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("seen_at"))
    return o.unionByName(e).orderBy(F.desc("seen_at"), "kind", "id").limit(40)


@register("union_distinct", "SELECT l_suppkey AS id FROM lineitem WHERE l_quantity > 45 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")
def union_distinct(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_suppkey").alias("id"))
    return a.union(table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select("s_suppkey")).distinct()


_HALVES = "old AS (SELECT user_id, event_type, max(value) AS value, min(ts) AS first_seen FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2), new AS (SELECT user_id, event_type, max(value) AS value, min(ts) AS first_seen FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1, 2)"


def halves(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    side = lambda c: e.filter(c).groupBy("user_id", "event_type").agg(F.max("value").alias("value"), F.min("ts").alias("first_seen"))
    return side("ts < TIMESTAMP '2024-01-16'"), side("ts >= TIMESTAMP '2024-01-16'")


@register("upsert_snapshot", f"""WITH {_HALVES} SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_type, o.event_type) AS event_type,
CASE WHEN n.user_id IS NOT NULL THEN n.value ELSE o.value END AS value, coalesce(o.first_seen, n.first_seen) AS first_seen FROM new n FULL JOIN old o ON n.user_id = o.user_id AND n.event_type = o.event_type""")  # fmt: skip
def upsert_snapshot(spark, sf_dir):
    old, new = halves(spark, sf_dir)
    return R.upsert(old, new, ["user_id", "event_type"], keep=("first_seen",))


@register("insert_ignore", f"""WITH {_HALVES} SELECT * FROM old UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.user_id = n.user_id AND o.event_type = n.event_type)""")
def insert_ignore(spark, sf_dir):
    return R.insert_ignore(*halves(spark, sf_dir), ["user_id", "event_type"])


@register("set_difference", """SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A'""")
def set_difference(spark, sf_dir):
    p = lambda f: table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == f).select("l_orderkey")
    return p("R").subtract(p("A"))


@register("membership", "SELECT p_partkey FROM part WHERE p_size IN (3, 9, 27) AND p_brand NOT IN ('Brand#11', 'Brand#12')")
def membership(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.col("p_size").isin(3, 9, 27) & ~F.col("p_brand").isin("Brand#11", "Brand#12")).select("p_partkey")
