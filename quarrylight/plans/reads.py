"""Read interfaces: listings, histories, inventories, registries, searches and roll-ups over the synthetic tables."""

from pyspark.sql import functions as F

from quarrylight.functions import html as H
from quarrylight.operators import evaluation as E
from quarrylight.operators import integrity as I
from quarrylight.operators import relational as R
from quarrylight.registry import register
from quarrylight.session import table


@register("files_listed", "SELECT doc_id, lang, source, n_chars FROM documents WHERE contains(lower(source), '1') ORDER BY source, doc_id LIMIT 50")
def files_listed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(I.any_like("1", "source"))
    return d.select("doc_id", "lang", "source", "n_chars").orderBy("source", "doc_id").limit(R.clamp(50, 500))


@register("relations_of", """SELECT 'outgoing' AS direction, l_orderkey AS relation, l_partkey AS subject, l_suppkey AS object FROM lineitem WHERE l_partkey = 9 AND l_linestatus = 'F'
UNION ALL SELECT 'incoming', l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey = 9 AND l_partkey <> 9 AND l_linestatus = 'F'""")  # fmt: skip
def relations_of(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("relation"), F.col("l_partkey").alias("subject"), F.col("l_suppkey").alias("object"))
    direction = F.when(F.col("subject") == 9, "outgoing").when(F.col("object") == 9, "incoming")
    return r.filter("subject = 9 OR object = 9").select(direction.alias("direction"), "relation", "subject", "object")


@register("inventory_with_advisories", """WITH f AS (SELECT 'npm' AS ecosystem, p_brand AS name, count(*) AS n FROM part WHERE p_size > 40 GROUP BY 1, 2)
SELECT i.ecosystem, i.name, i.version, coalesce(f.n, 0) AS open_advisories FROM (SELECT DISTINCT 'npm' AS ecosystem, p_brand AS name, p_size || '.0' AS version FROM part) i LEFT JOIN f ON f.name = i.name""")  # fmt: skip
def inventory_with_advisories(spark, sf_dir):
    """Open findings carry their package as JSON; it is taken apart once and counted before the join."""
    p = table(spark, sf_dir, "part")
    inventory = p.select(F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("name"), F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("version")).distinct()
    findings = p.select(F.to_json(F.struct(F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("name"))).alias("meta"), F.when(F.col("p_size") > 40, "open").otherwise("resolved").alias("status"))
    key = lambda k: F.get_json_object("meta", f"$.{k}").alias(k)
    open_ = findings.filter("status = 'open'").groupBy(key("ecosystem"), key("name")).agg(F.count(F.lit(1)).alias("n"))
    return inventory.join(open_, ["ecosystem", "name"], "left").select("ecosystem", "name", "version", F.coalesce("n", F.lit(0)).alias("open_advisories"))


@register("plan_history", "SELECT o_custkey AS plan, o_orderkey AS change, o_orderdate AS at_time, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders QUALIFY place <= 5")
def plan_history(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("change"), F.col("o_orderdate").alias("at_time"))
    return R.top_per_key(o, ["plan"], [F.desc("at_time"), F.desc("change")], 5, "place")


@register("run_list_by_state", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('P', 'O') ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def run_list_by_state(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("P", "O")).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_orderstatus")


@register("cleanup_holds", "SELECT count(*) AS held FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'F'")
def cleanup_holds(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") != "F")).agg(F.count(F.lit(1)).alias("held"))


@register("inference_history", "SELECT event_id, event_type, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def inference_history(spark, sf_dir):
    e = R.where_given(table(spark, sf_dir, "events"), event_type="error", user_id=None)
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "event_type", "value")


_TOOLS = [("quality", "index", None), ("graph", "index", None), ("deps", None, None), ("review", "index", "quality")]


@register("tools_available", """WITH t(tool, needs, after) AS (VALUES ('quality', 'index', NULL), ('graph', 'index', NULL), ('deps', NULL, NULL), ('review', 'index', 'quality')),
p AS (SELECT c_custkey AS project, count(o_orderkey) FILTER (o_orderstatus = 'F') > 0 AS indexed, count(o_orderkey) FILTER (o_orderstatus = 'O') > 0 AS assessed FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT tool, count(*) FILTER ((needs IS NULL OR indexed) AND (after IS NULL OR assessed)) AS available, count(*) AS projects FROM t, p GROUP BY 1""")  # fmt: skip
def tools_available(spark, sf_dir):
    """Projects' facts are gathered once; the catalogue, a handful of rows, becomes one condition a tool."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("indexed"), F.bool_or(F.col("o_orderstatus") == "O").alias("assessed"))
    p = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.coalesce("indexed", F.lit(False)).alias("indexed"), F.coalesce("assessed", F.lit(False)).alias("assessed"))
    tools = F.array(*[F.struct(F.lit(t).alias("tool"), ((F.lit(needs is None) | F.col("indexed")) & (F.lit(after is None) | F.col("assessed"))).alias("ok")) for t, needs, after in _TOOLS])
    return p.select(F.explode(tools).alias("t")).groupBy("t.tool").agg(F.count_if("t.ok").alias("available"), F.count(F.lit(1)).alias("projects"))


@register("memory_search", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'an') OR contains(lower(role), 'an')")
def memory_search(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter(I.any_like("AN", "text", "role")).select("conv_id", "turn")


@register("fix_attempts", """SELECT l_orderkey AS finding, count(*) AS attempts, count(*) >= 3 AS limit_reached, bool_and(l_linestatus = 'F') AS all_passed, bool_or(l_returnflag = 'R') AS any_failed,
CASE WHEN bool_or(l_returnflag = 'R') THEN 'failed' WHEN bool_and(l_linestatus = 'F') THEN 'passed' ELSE 'partial' END AS validation FROM lineitem GROUP BY 1""")  # fmt: skip
def fix_attempts(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("finding")).agg(F.count(F.lit(1)).alias("attempts"), F.bool_and(F.col("l_linestatus") == "F").alias("all_passed"), F.bool_or(F.col("l_returnflag") == "R").alias("any_failed"))
    return g.withColumns({"limit_reached": F.col("attempts") >= 3, "validation": F.when(F.col("any_failed"), "failed").when(F.col("all_passed"), "passed").otherwise("partial")})


@register("evidence_listed", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS place FROM lineitem QUALIFY place <= 3")
def evidence_listed(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return R.top_per_key(li, ["l_orderkey"], [F.col("l_shipdate"), F.col("l_linenumber")], 3, "place").drop("l_shipdate")


@register("guarded_append_empty", "SELECT coalesce(max(event_id), 0) + 1 AS next_seq FROM events WHERE event_type = 'nothing of the kind' HAVING coalesce(max(event_id), 0) < 100")
def guarded_append_empty(spark, sf_dir):
    """A log without a row still gives the first number: the aggregate is over the whole selection."""
    log = table(spark, sf_dir, "events").filter("event_type = 'nothing of the kind'")
    return log.agg((F.coalesce(F.max("event_id"), F.lit(0)) + 1).alias("next_seq")).filter("next_seq <= 100")


@register("missing_columns_as_null", "SELECT doc_id, lang, NULL::VARCHAR AS licence FROM documents")
def missing_columns_as_null(spark, sf_dir):
    from quarrylight.session import columns

    return columns(table(spark, sf_dir, "documents"), ["doc_id", "lang", "licence"])


@register("cwe_recall", """WITH v AS (SELECT p_partkey, p_size % 4 <> 0 AS vulnerable, ['CWE-' || p_size % 7, 'CWE-' || p_size % 3] AS labelled, CASE WHEN p_size % 5 = 0 THEN [] ELSE ['CWE-' || p_size % 7, 'CWE-x'] END AS observed FROM part),
e AS (SELECT unnest(list_distinct(labelled)) AS cwe, observed FROM v WHERE vulnerable)
SELECT cwe, count(*) AS samples, round(count(*) FILTER (len(observed) > 0) / count(*), 6) AS recall_any, round(count(*) FILTER (list_contains(observed, cwe)) / count(*), 6) AS recall_same_cwe FROM e GROUP BY 1""")  # fmt: skip
def cwe_recall(spark, sf_dir):
    cwe = lambda n: F.concat(F.lit("CWE-"), (F.col("p_size") % n).cast("string"))
    observed = F.when(F.col("p_size") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(cwe(7), F.lit("CWE-x")))
    rows = table(spark, sf_dir, "part").select((F.col("p_size") % 4 != 0).alias("vulnerable"), F.array(cwe(7), cwe(3)).alias("labelled"), observed.alias("observed"))
    return E.cwe_recall(rows)


_AREA = "CASE WHEN s = '' THEN 'Root' ELSE upper(s[1]) || s[2:] END"


@register("app_map_groups", f"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS s, url, lower(html) AS h FROM pages)
SELECT {_AREA} AS area, count(*) AS pages, count(*) FILTER (contains(h, '<form')) AS forms, count(*) FILTER (regexp_matches(url, '/api/|\\.json')) AS apis, count(*) FILTER (contains(url, '?')) AS parameters,
count(*) FILTER (regexp_matches(lower(url), 'login|signin|auth|account')) AS auth FROM p GROUP BY 1""")  # fmt: skip
def app_map_groups(spark, sf_dir):
    return H.application_map(table(spark, sf_dir, "pages"))


_TAG = r"""(<(?:a|link|script|img|form)\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>)"""
_ATTR = r"""[\s"''](?:href|src|action)\s*=\s*["'']?([^"''\s>]+)"""


@register("html_link_inventory", f"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '{_TAG}', 1, 'si')) AS tag FROM pages), l AS (SELECT page_id, unnest(regexp_extract_all(tag, '{_ATTR}', 1, 'si')) AS u FROM t)
SELECT page_id, count(DISTINCT split_part(u, '#', 1)) AS n_links FROM l WHERE regexp_matches(u, '^https?://') OR starts_with(u, '/') GROUP BY 1""")  # fmt: skip
def html_link_inventory(spark, sf_dir):
    wanted = F.array_distinct(F.transform(F.filter(H.link_targets(F.col("html")), lambda u: u.rlike("^(https?://|/)")), lambda u: F.split_part(u, F.lit("#"), F.lit(1))))
    return table(spark, sf_dir, "pages").select("page_id", F.size(wanted).cast("long").alias("n_links")).filter("n_links > 0")


@register("resolved_links", f"""WITH t AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{_TAG}', 1, 'si')) AS tag FROM pages), l AS (SELECT page_id, url, split_part(unnest(regexp_extract_all(tag, '{_ATTR}', 1, 'si')), '#', 1) AS u FROM t)
SELECT DISTINCT page_id, CASE WHEN starts_with(u, '/') THEN lower(regexp_extract(url, '^[a-z]+://[^/?#]+', 0)) || u ELSE u END AS link FROM l WHERE u <> '' AND (starts_with(u, '/') OR regexp_matches(u, '^https?://'))""")  # fmt: skip
def resolved_links(spark, sf_dir):
    """Links of absolute paths and whole URLs, as the pages have them."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(H.links(F.col("html"), F.col("url"))).alias("link"))


@register("test_plan_operations", """WITH p AS (SELECT page_id, split_part(url, '?', 1) AS url, CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'DELETE' END AS method, CASE WHEN page_id % 2 = 0 THEN ['query'] ELSE ['query', 'body'] END AS at_id FROM pages),
k AS (SELECT url, method, 'q' AS parameter, 'query' AS location FROM p UNION ALL SELECT url, method, 'id', 'query' FROM p WHERE len(at_id) = 1)
SELECT sha256(encode(url) || unhex('00') || encode(method) || unhex('00') || encode(parameter) || unhex('00') || encode(category) || unhex('00')) AS key, url, method, parameter, location, category,
CASE method WHEN 'GET' THEN 'safe' WHEN 'DELETE' THEN 'restricted' ELSE 'caution' END AS risk, method = 'GET' AS selected FROM k, (VALUES ('sqli'), ('xss')) c(category)""")  # fmt: skip
def test_plan_operations(spark, sf_dir):
    from quarrylight.operators.workflow import test_plan

    k = F.col("page_id") % 3
    at_id = F.when(F.col("page_id") % 2 == 0, F.array(F.lit("query"))).otherwise(F.array(F.lit("query"), F.lit("body")))
    endpoints = table(spark, sf_dir, "pages").select(F.split_part("url", F.lit("?"), F.lit(1)).alias("url"), F.when(k == 0, "get").when(k == 1, "post").otherwise("delete").alias("method"), F.create_map(F.lit("q"), F.array(F.lit("query")), F.lit("id"), at_id).alias("parameters"))
    categories = spark.createDataFrame([("sqli", ["query", "path"]), ("xss", ["query"])], "category string, locations array<string>")
    return test_plan(endpoints, categories)


@register("bill_of_materials", """WITH g AS (SELECT lower(p_brand) AS name, p_size || '.1.0' AS version, bool_and(p_type LIKE '%STEEL%') AS dev FROM part GROUP BY 1, 2)
SELECT 'npm' AS ecosystem, name, version, CASE WHEN dev THEN 'optional' ELSE 'required' END AS scope, 'pkg:npm/' || replace(name, '#', '%23') || '@' || version AS purl FROM g""")  # fmt: skip
def bill_of_materials(spark, sf_dir):
    from quarrylight.operators.advisories import bill_of_materials as bom

    p = table(spark, sf_dir, "part").select(F.lit("npm").alias("ecosystem"), F.lower("p_brand").alias("name"), F.concat(F.col("p_size").cast("string"), F.lit(".1.0")).alias("version"), F.contains("p_type", F.lit("STEEL")).alias("is_dev"), F.lit("lock").alias("manifest_path"))
    return bom(p).select("ecosystem", "name", "version", "scope", "purl")


@register("bill_of_materials_document", """SELECT 'CycloneDX' AS format, '1.5' AS spec, count(*) AS components, count(*) FILTER (dev) AS optional FROM (SELECT p_brand, p_size, bool_and(p_type LIKE '%STEEL%') AS dev FROM part GROUP BY 1, 2)""")
def bill_of_materials_document(spark, sf_dir):
    """The document's parts are written by every task and read back: one header line and one line a component."""
    from quarrylight.operators.advisories import bill_of_materials as bom
    from quarrylight.session import scratch
    from quarrylight.sources.sinks import write_bill_of_materials

    p = table(spark, sf_dir, "part").select(F.lit("npm").alias("ecosystem"), F.lower("p_brand").alias("name"), F.concat(F.col("p_size").cast("string"), F.lit(".1.0")).alias("version"), F.contains("p_type", F.lit("STEEL")).alias("is_dev"), F.lit("lock").alias("manifest_path"))
    path = scratch(spark, "bom")
    write_bill_of_materials(bom(p), "main", path)
    header = spark.read.json(f"{path}/header").select(F.col("bomFormat").alias("format"), F.col("specVersion").alias("spec"))
    parts = spark.read.json(f"{path}/components").agg(F.count(F.lit(1)).alias("components"), F.count_if(F.col("scope") == "optional").alias("optional"))
    return header.join(F.broadcast(parts))


@register("scan_report", """SELECT o_orderpriority AS severity, count(DISTINCT o_orderkey) AS findings, count(l_orderkey) AS evidence, max(o_totalprice) AS worst FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def scan_report(spark, sf_dir):
    """What a scan's report shows by severity; sinks.report renders it."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.groupBy(F.col("o_orderpriority").alias("severity")).agg(F.count(F.lit(1)).alias("findings"), F.coalesce(F.sum("n"), F.lit(0)).alias("evidence"), F.max("o_totalprice").alias("worst"))


@register("consecutive_duplicates", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def consecutive_duplicates(spark, sf_dir):
    """Equal keys after a sort are equal keys anywhere: one aggregate, no sort."""
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").dropDuplicates()


@register("stride_sample_files", """WITH e AS (SELECT event_type AS file, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events),
s AS (SELECT greatest(1, ceil(count(*) / 300))::BIGINT AS s FROM e), r AS (SELECT file, event_id, row_number() OVER (ORDER BY file, i) AS k FROM e, s WHERE i % s = 0) SELECT file, event_id FROM r WHERE k <= 300""")  # fmt: skip
def stride_sample_files(spark, sf_dir):
    """Event types stand for files; in a Parquet scan file and place come from _metadata."""
    from pyspark.sql import Window

    from quarrylight.sources.sampling import stride_sample_files as sample

    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("file"), "event_id")
    placed = e.withColumn("i", F.row_number().over(Window.partitionBy("file").orderBy("event_id")) - 1)
    return sample(placed, "file", "i", 300).select("file", "event_id")


@register("fenced_by_hash", "SELECT a.doc_id FROM documents a JOIN (SELECT doc_id, sha256(CASE WHEN n_chars < 300 THEN text || 'x' ELSE text END) AS h, source NOT LIKE '%1' AS live FROM documents) b USING (doc_id) WHERE sha256(a.text) = b.h AND b.live")
def fenced_by_hash(spark, sf_dir):
    """Relations recorded against a text count only while that file is active and its content is the same."""
    d = table(spark, sf_dir, "documents")
    now = d.select("doc_id", F.sha2(F.when(F.col("n_chars") < 300, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("h"), (~F.col("source").endswith("1")).alias("live"))
    return d.select("doc_id", F.sha2("text", 256).alias("h")).join(now.filter("live"), ["doc_id", "h"]).select("doc_id")


_RANKS = "CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS action, o_orderkey % 3 AS category, o_orderkey % 4 AS eligibility, left(o_orderpriority, 1)::INTEGER AS severity, 'f' || o_orderkey % 5 AS path"


@register("campaign_order", f"""WITH f AS (SELECT o_custkey AS campaign, o_orderkey AS id, {_RANKS} FROM orders), o AS (SELECT campaign, id, path, row_number() OVER (PARTITION BY campaign ORDER BY action, category, eligibility, severity, path, id) AS ordinal FROM f)
SELECT campaign, id, ordinal, coalesce((SELECT list(b.id ORDER BY b.ordinal) FROM o b WHERE b.campaign = o.campaign AND b.path = o.path AND b.ordinal < o.ordinal), []) AS depends_on FROM o""")  # fmt: skip
def campaign_order(spark, sf_dir):
    from quarrylight.operators.workflow import campaign_order as order

    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    ranks = {"action": F.when(s == "O", 0).when(s == "P", 1).otherwise(2), "category": k % 3, "eligibility": k % 4, "severity": F.substring("o_orderpriority", 1, 1).cast("int"), "path": F.concat(F.lit("f"), (k % 5).cast("string"))}
    return order(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("campaign"), k.alias("id"), *[c.alias(n) for n, c in ranks.items()]))


_RUNS = """s AS (SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS position, CASE WHEN l_linestatus = 'F' THEN 'completed' WHEN l_returnflag = 'N' AND l_quantity > 45 THEN 'running' WHEN l_quantity > 25 THEN 'failed' ELSE 'skipped' END AS status FROM lineitem)"""


@register("follow_up_plan", f"""WITH {_RUNS}, d AS (SELECT run_id, bool_or(position = 2 AND status = 'completed') AS ok FROM s JOIN orders ON o_orderkey = run_id WHERE o_orderstatus IN ('F', 'P') GROUP BY 1
  HAVING count(*) > 1 AND NOT bool_or(status = 'running') AND (NOT bool_or(position = 2 AND status = 'completed') OR bool_or(position > 2 AND status <> 'completed'))),
r AS (SELECT run_id, -2 AS p, 'scout' AS role, NULL AS depends_on FROM d UNION ALL SELECT run_id, -1, 'source', 'scout' FROM d UNION ALL SELECT s.run_id, s.position, 'r' || s.position, 'source' FROM s JOIN d ON d.run_id = s.run_id WHERE ok AND s.position > 2 AND status <> 'completed')
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY p) AS position, role, depends_on FROM r""")  # fmt: skip
def follow_up_plan(spark, sf_dir):
    """Runs that failed or were interrupted begin again; where their source gate held, with what else is left."""
    from pyspark.sql import Window

    from quarrylight.operators.workflow import follow_up

    position = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    status = F.when(F.col("l_linestatus") == "F", "completed").when((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 45), "running").when(F.col("l_quantity") > 25, "failed").otherwise("skipped")
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), position.alias("position"), status.alias("status"))
    role = F.when(F.col("position") == 1, "scout").when(F.col("position") == 2, "source").otherwise(F.concat(F.lit("r"), F.col("position").cast("string")))
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "interrupted").otherwise("running").alias("status"))
    return follow_up(runs, steps.withColumn("role", role))


_MOUNTS = """m AS (SELECT p_partkey AS target, CASE WHEN p_partkey % 40 = 7 THEN p_partkey + 1 WHEN p_partkey % 40 = 8 THEN p_partkey - 1 ELSE p_partkey // (2 + p_size % 3) END AS source, CASE WHEN p_size = 50 THEN 'other' ELSE 'express' END AS framework,
CASE WHEN p_size % 4 = 0 THEN 'default' WHEN p_size % 11 = 0 THEN 'gone' ELSE 'r' || p_partkey % 3 END AS name, '/p' || p_partkey % 11 || '/' AS prefix, p_size % 9 = 0 AS over FROM part)"""


@register("mounts_expanded", f"""WITH RECURSIVE {_MOUNTS}, w AS (SELECT page_id AS route_id, page_id * 7 + 1 AS at, 'r' || (page_id * 7 + 1) % 3 AS by, '' AS gathered, false AS over, []::BIGINT[] AS seen, 0 AS depth FROM pages
UNION ALL SELECT w.route_id, m.source, 'r' || m.source % 3, '/' || trim(regexp_replace(m.prefix || '/' || w.gathered, '/+', '/', 'g'), '/'), w.over OR m.over, list_append(w.seen, m.target::BIGINT), w.depth + 1
  FROM w JOIN m ON m.target = w.at AND m.framework = 'express' AND (m.name = 'default' OR m.name = w.by) AND m.source > 0 AND NOT list_contains(w.seen, m.target::BIGINT) WHERE w.depth < 8),
e AS (SELECT w.* FROM w LEFT JOIN m ON m.target = w.at AND m.framework = 'express' AND (m.name = 'default' OR m.name = w.by) AND m.source > 0 AND NOT list_contains(w.seen, m.target::BIGINT) WHERE w.depth = 8 OR m.target IS NULL)
SELECT DISTINCT route_id, '/' || trim(regexp_replace(gathered || '/' || CASE WHEN over THEN '/x' || route_id ELSE '/base/x' || route_id END, '/+', '/', 'g'), '/') AS full FROM e""")  # fmt: skip
def mounts_expanded(spark, sf_dir):
    """Routes of every page under the mounts that a tree of parts, with circles and over eight deep, makes."""
    from quarrylight.operators.workflow import expand_mounts

    key, router = F.col("p_partkey"), lambda c: F.concat(F.lit("r"), (c % 3).cast("string"))
    source = F.when(key % 40 == 7, key + 1).when(key % 40 == 8, key - 1).otherwise(F.floor(key / (2 + F.col("p_size") % 3)))
    name = F.when(F.col("p_size") % 4 == 0, "default").when(F.col("p_size") % 11 == 0, "gone").otherwise(router(key))
    mounts = table(spark, sf_dir, "part").select(source.alias("source_file"), key.alias("target_file"), F.when(F.col("p_size") == 50, "other").otherwise("express").alias("framework"), router(source).alias("parent_router"), name.alias("imported_name"),
        F.lit("b").alias("binding"), F.concat(F.lit("/p"), (key % 11).cast("string"), F.lit("/")).alias("prefix"), (F.col("p_size") % 9 == 0).alias("override")).filter("source_file > 0")
    file = F.col("page_id") * 7 + 1
    routes = table(spark, sf_dir, "pages").select(F.col("page_id").alias("route_id"), file.alias("file"), F.lit("express").alias("framework"), router(file).alias("router"), F.lit("/base").alias("router_prefix"), F.concat(F.lit("/base/x"), F.col("page_id").cast("string")).alias("template"))
    return expand_mounts(routes, mounts)


@register("findings_filtered", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' AND contains(lower(o_orderpriority), 'high') AND o_totalprice >= 1000 ORDER BY o_orderpriority, o_orderkey LIMIT 200")
def findings_filtered(spark, sf_dir):
    """Six optional filters, of which three are given, a text sought, a bound and a limit."""
    o = R.where_given(table(spark, sf_dir, "orders"), o_orderstatus="O", o_orderpriority="2-HIGH", o_custkey=None, o_orderkey=None, o_orderdate=None)
    return o.filter(I.any_like("HIGH", "o_orderpriority") & (F.col("o_totalprice") >= 1000)).orderBy("o_orderpriority", "o_orderkey").limit(R.clamp(200, 500)).select("o_orderkey")
