"""Text, URL, vector and html queries."""

from pyspark.sql import functions as F

from quarrylight.functions import html as H
from quarrylight.functions import scalar as S
from quarrylight.registry import register
from quarrylight.session import beside, table

_TOK = 'token = "([0-9a-f]{40})"'
_TOKENS = f"t AS (SELECT doc_id, regexp_extract(text, '{_TOK}', 1) AS tok FROM documents WHERE regexp_matches(text, '{_TOK}'))"


def _tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").rlike(_TOK))
    return d.select("doc_id", F.regexp_extract("text", _TOK, 1).alias("tok"))


@register("deterministic_ids", "SELECT doc_id, 'file:' || sha256('file'::BLOB || unhex(lpad(printf('%x', strlen(source)), 16, '0')) || encode(source) || unhex(lpad(printf('%x', strlen(lang)), 16, '0')) || encode(lang)) AS id FROM documents")
def deterministic_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.deterministic_id("file", F.col("source"), F.col("lang")).alias("id"))


@register("fingerprints", "SELECT page_id, sha256(encode(url) || unhex('00') || encode('GET') || unhex('00')) AS fingerprint FROM pages")
def fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.fingerprint(F.col("url"), F.lit("GET")).alias("fingerprint"))


@register("redact_tokens", f"WITH {_TOKENS} SELECT doc_id, tok[1:4] || '…' || tok[39:40] AS redacted FROM t")
def redact_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", S.redact(F.col("tok")).alias("redacted"))


@register("entropy_of_tokens", f"WITH {_TOKENS} SELECT doc_id, round(list_sum(list_transform(list_distinct(string_split(tok, '')), lambda c: -(len(list_filter(string_split(tok, ''), lambda x: x = c)) / 40.0::DOUBLE) * log2(len(list_filter(string_split(tok, ''), lambda x: x = c)) / 40.0::DOUBLE))), 6) AS entropy FROM t")
def entropy_of_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", F.round(S.shannon_entropy(F.col("tok")), 6).alias("entropy"))


@register("redacted_urls", r"SELECT page_id, regexp_replace(split_part(url, '#', 1), '([?&])(ref)=[^&]*', '\1\2=REDACTED', 'g') AS url FROM pages")
def redacted_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.redact_url(F.col("url")).alias("url"))


@register("mixed_content", """SELECT split_part(url, ':', 1) AS scheme, count(*) AS pages, count(*) FILTER (starts_with(url, 'https://') AND contains(lower(html), 'http://')) AS mixed, count(*) FILTER (regexp_matches(html, '<form')) AS with_forms FROM pages GROUP BY 1""")
def mixed_content(spark, sf_dir):
    from quarrylight.operators import pages as P

    p = table(spark, sf_dir, "pages")
    with_form = P.forms(P.tokens(p.select(F.col("page_id").alias("id"), "html"))).select(F.col("id").alias("page_id")).distinct().withColumn("_form", F.lit(True))
    mixed = F.col("url").startswith("https://") & F.contains(F.lower("html"), F.lit("http://"))
    rows = p.join(with_form, "page_id", "left").groupBy(F.split_part("url", F.lit(":"), F.lit(1)).alias("scheme"))
    return rows.agg(F.count(F.lit(1)).alias("pages"), F.count_if(mixed).alias("mixed"), F.count_if("_form").alias("with_forms"))


@register("rfc3339", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at_text FROM events")
def rfc3339(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.rfc3339(F.unix_timestamp(F.date_trunc("second", "ts"))).alias("at_text"))


@register("certificate_states", """SELECT event_id, CASE WHEN ts <= TIMESTAMP '2024-01-10' THEN 'expired' WHEN date_diff('second', TIMESTAMP '2024-01-10', date_trunc('second', ts)) // 86400 <= 14 THEN 'expiring_soon' ELSE 'valid' END AS state FROM events""")
def certificate_states(spark, sf_dir):
    now = F.to_timestamp(F.lit("2024-01-10 00:00:00"))
    return table(spark, sf_dir, "events").select("event_id", S.certificate_state(F.to_timestamp(F.lit("2023-01-01 00:00:00")), F.col("ts"), now, 14).alias("state"))


@register("vector_topk", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7)
SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q.e::DOUBLE[]), 5) AS score FROM embeddings, q WHERE vec_id <> 7 AND list_dot_product(embedding::DOUBLE[], q.e::DOUBLE[]) > 0 ORDER BY score DESC, vec_id LIMIT 25""")  # fmt: skip
def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    query = e.filter("vec_id = 7").select(F.col("embedding").alias("q"))  # one row
    scored = e.filter("vec_id <> 7").join(F.broadcast(query)).select("vec_id", F.round(S.dot(F.col("embedding"), F.col("q")), 5).alias("score"))
    return scored.filter("score > 0").orderBy(F.desc("score"), "vec_id").limit(25)


@register("vector_topk_batch", """WITH s AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM s WHERE score > 0 QUALIFY place <= 25""")  # fmt: skip
def vector_topk_batch(spark, sf_dir):
    """The 25 nearest rows of every vector whose id is divisible by 100."""
    from quarrylight.operators.vectors import top_k

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return top_k(e, e.filter("id % 100 = 0"))


@register("vector_check", "SELECT label, count(*) AS n, count(*) FILTER (abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 0.001) AS not_unit, 0::BIGINT AS invalid FROM embeddings GROUP BY 1")
def vector_check(spark, sf_dir):
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(S.norm(v) - 1) > 0.001).alias("not_unit"), F.count_if(S.vector_problem(v).isNotNull()).alias("invalid"))


@register("lexical_vectors", """WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^0-9a-z]+'), lambda x: x <> '')[1:48] AS toks FROM benchmark),
p AS (SELECT item_id, ('0x' || sha256(unnest(toks))[1:4])::INTEGER % 64 AS d FROM t), c AS (SELECT item_id, d, count(*) AS n FROM p GROUP BY 1, 2)
SELECT item_id, d AS dimension, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS weight FROM c""")  # fmt: skip
def lexical_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(S.lexical_vector(F.col("text"))).alias("dimension", "w"))
    return v.filter("w > 0").select("item_id", "dimension", F.round("w", 6).alias("weight"))


@register("package_inventory", """SELECT p_brand AS name, p_size::VARCHAR || '.0' AS version, count(*) AS parts FROM part GROUP BY 1, 2""")
def package_inventory(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name"), F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("version")).agg(F.count(F.lit(1)).alias("parts"))


# Versions are a.b.c, -beta of it or -rc.n of it; in SQL they are the integers that sort alike.
_SORTED = lambda a, b, c, k, n: f"(((({a}) * 100 + ({b})) * 100 + ({c})) * 10 + CASE ({k}) % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END) * 100 + CASE WHEN ({k}) % 4 = 2 THEN ({n}) ELSE 0 END"
_PART_VERSION = ("p_partkey % 5", "p_partkey % 11", "p_partkey % 3", "p_partkey", "p_partkey % 13")
_FROM = ("(l_suppkey + l_linenumber) % 5", "l_quantity::BIGINT % 11", "l_suppkey % 3", "l_orderkey", "l_orderkey % 13")
_TO = ("(l_suppkey + l_linenumber) % 5", "l_quantity::BIGINT % 11 + 1 + l_linenumber % 2", "0", "l_partkey", "l_partkey % 13")


def _text(parts):
    a, b, c, k, n = [F.expr(x.replace("l_quantity::BIGINT", "cast(l_quantity AS bigint)")) for x in parts]
    end = F.when(k % 4 == 1, F.lit("-beta")).when(k % 4 == 2, F.concat(F.lit("-rc."), n.cast("string"))).otherwise("")
    return F.concat(F.concat_ws(".", a.cast("string"), b.cast("string"), c.cast("string")), end)


def _inventory(spark, sf_dir):
    name = F.concat(F.col("p_brand"), F.lit("-"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.lit("PyPI").alias("ecosystem"), name.alias("name"), _text(_PART_VERSION).alias("version"))


def _advisory_lines(spark, sf_dir, event, dealt=True):
    """lines(l_orderkey, affected), dealt by order if not told otherwise: each order line affects its part's package, written in another way: one or two intervals, some open, some of every version so far. event(kind, value) makes an event."""
    kind = F.when(F.col("l_returnflag") == "A", "fixed").when(F.col("l_returnflag") == "N", "limit").otherwise("last_affected")
    start = F.when(F.col("l_orderkey") % 19 == 0, "0").otherwise(_text(_FROM))
    lines = table(spark, sf_dir, "lineitem").join(beside(_inventory(spark, sf_dir)), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "ecosystem", "name", "version")
    if dealt:
        lines = lines.repartition("l_orderkey")  # while they are narrow
    lines = lines.select("*", start.alias("start"), kind.alias("kind"), _text(_TO).alias("stop"))
    first, then = event(F.lit("introduced"), F.col("start")), event(F.col("kind"), F.col("stop"))
    later = event(F.lit("introduced"), F.lit("9.0")), event(F.lit("fixed"), F.lit("9.2-rc.1"))
    events = F.when(F.col("l_orderkey") % 17 == 0, F.array(first)).when(F.col("l_linenumber") % 2 == 0, F.array(first, then, *later)).otherwise(F.array(first, then))
    ranges = F.array(F.struct(F.when(F.col("l_orderkey") % 29 == 0, "GIT").otherwise("SEMVER").alias("type"), events.alias("events")))
    listed = F.when(F.col("l_orderkey") % 7 == 0, F.array("version")).otherwise(F.array().cast("array<string>"))
    package = F.struct("ecosystem", F.upper(F.translate("name", "-", "_")).alias("name"))
    return lines.select("l_orderkey", F.struct(package.alias("package"), listed.alias("versions"), ranges.alias("ranges")).alias("affected"))


def _advisory_head():
    """id and withdrawn of an order's advisory."""
    return F.concat(F.lit("ADV-"), F.col("l_orderkey").cast("string")).alias("id"), F.when(F.col("l_orderkey") % 23 == 0, "2024-01-01").alias("withdrawn")


def _event(kind, value):
    return F.struct(kind.alias("kind"), value.alias("value"))


def _lines_affected(spark, sf_dir):
    """What the advisories of all orders affect, a row for each line; without withdrawn ones."""
    lines = _advisory_lines(spark, sf_dir, _event, dealt=False)
    lines = lines.select(*_advisory_head(), "affected").filter(F.col("withdrawn").isNull())
    return lines.select("id", F.col("affected.package.ecosystem").alias("ecosystem"), F.col("affected.package.name").alias("name"), "affected.versions", "affected.ranges")


def _order_advisories(spark, sf_dir):
    """An advisory for every order, with what its lines affect."""
    lines = _advisory_lines(spark, sf_dir, _event)
    return lines.groupBy("l_orderkey").agg(F.collect_list("affected").alias("affected")).select(*_advisory_head(), "affected")  # an order has few lines


def _advisory_texts(spark, sf_dir):
    """The same advisories as JSON texts (value), an event as an object of its kind; a line's part is written before the texts of an order are gathered."""
    lines = _advisory_lines(spark, sf_dir, F.create_map).select("l_orderkey", F.to_json("affected").alias("affected"))
    orders = lines.groupBy("l_orderkey").agg(F.collect_list("affected").alias("affected"))
    around = F.to_json(F.struct(*_advisory_head(), F.array().cast("array<string>").alias("affected")))  # ends in []}
    return orders.select(F.concat(F.substr(around, F.lit(1), F.length(around) - 2), F.array_join("affected", ","), F.lit("]}")).alias("value"))


@register("advisory_range_join", f"""WITH inv AS (SELECT DISTINCT p_brand || '-' || p_size AS name, {_SORTED(*_PART_VERSION)} AS v FROM part),
own AS (SELECT p_partkey, p_brand || '-' || p_size AS name, {_SORTED(*_PART_VERSION)} AS v FROM part),
li AS (SELECT l_orderkey AS o, own.name, own.v AS listed, CASE WHEN l_orderkey % 19 = 0 THEN -1 ELSE {_SORTED(*_FROM)} END AS lo, CASE WHEN l_orderkey % 17 = 0 THEN 99999999999 ELSE {_SORTED(*_TO)} END AS hi, l_returnflag = 'R' OR l_orderkey % 17 = 0 AS incl
  FROM lineitem JOIN own ON p_partkey = l_partkey WHERE l_orderkey % 23 <> 0),
hit AS (SELECT inv.name, inv.v, o, CASE WHEN o % 7 = 0 AND inv.v = listed THEN 2 ELSE 1 END AS b FROM inv JOIN li ON li.name = inv.name AND ((o % 7 = 0 AND inv.v = listed) OR (o % 29 <> 0 AND inv.v >= lo AND (inv.v < hi OR (incl AND inv.v = hi)))))
SELECT name, ((v // 10000000))::VARCHAR || '.' || (v // 100000 % 100)::VARCHAR || '.' || (v // 1000 % 100)::VARCHAR || CASE v // 100 % 10 WHEN 1 THEN '-beta' WHEN 2 THEN '-rc.' || (v % 100)::VARCHAR ELSE '' END AS version, 'ADV-' || o AS advisory, CASE max(b) WHEN 2 THEN 'exact_version' ELSE 'range' END AS basis FROM hit GROUP BY name, v, o""")  # fmt: skip
def advisory_range_join(spark, sf_dir):
    """Thousands of advisories over the packages of all parts: intervals stabbed by versions, in an order where pre-releases come before releases."""
    from quarrylight.operators.advisories import match_affected

    return match_affected(_inventory(spark, sf_dir), _lines_affected(spark, sf_dir)).select("name", "version", "advisory", "basis")


@register("advisory_versions", f"""WITH inv AS (SELECT DISTINCT {_SORTED(*_PART_VERSION)} AS v FROM part), t AS (SELECT v, (v // 10000000)::VARCHAR || '.' || (v // 100000 % 100)::VARCHAR || '.' || (v // 1000 % 100)::VARCHAR || CASE v // 100 % 10 WHEN 1 THEN '-beta' WHEN 2 THEN '-rc.' || (v % 100)::VARCHAR ELSE '' END AS version FROM inv)
SELECT version, CASE WHEN v >= {_SORTED(1, 0, 0, 0, 0)} AND v < {_SORTED(1, 5, 0, 0, 0)} THEN 'A' WHEN v >= {_SORTED(2, 0, 0, 2, 1)} THEN 'B' END AS advisory FROM t""")  # fmt: skip
def advisory_versions(spark, sf_dir):
    """Every version of the parts against three advisories, one of them withdrawn: pre-releases before releases, numbers by value."""
    from quarrylight.operators.advisories import ADVISORY_SCHEMA, match_advisories

    spans = [("A", None, [("1.0.0", "1.5.0")]), ("B", None, [("2.0.0-rc.1", None)]), ("C", "2024-01-01", [("0", None)])]
    rows = [(i, w, [(("npm", "left"), [], [("SEMVER", [("introduced", a)] + ([("fixed", z)] if z else []))]) for a, z in ranges]) for i, w, ranges in spans]
    inventory = _inventory(spark, sf_dir).select(F.lit("npm").alias("ecosystem"), F.lit("left").alias("name"), "version").distinct()
    hit = match_advisories(inventory, spark.createDataFrame(rows, ADVISORY_SCHEMA)).select("version", "advisory")
    return inventory.select("version").join(hit, "version", "left")


@register("links_resolved", r"""WITH p AS (SELECT page_id, split_part(url, ':', 1) AS scheme, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS origin, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages),
s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS g FROM p), f AS (SELECT *, CASE WHEN path LIKE '%/' THEN g ELSE g[1:len(g) - 1] END AS folder FROM s)
SELECT page_id, array_to_string(list_sort([origin || '/x' || page_id || '?q=1', origin || '/' || array_to_string(list_append(folder[1:len(folder) - 1], 'z.html'), '/'), scheme || '://c.d/i' || page_id || '.png', origin || '/' || array_to_string(list_append(folder, 'j.js'), '/')]), ' ') AS links FROM f""")  # fmt: skip
def links_resolved(spark, sf_dir):
    """Rooted, relative, dotted and scheme-less links of every page against its url; fragments, mail and scripts go."""
    html = "concat('<a href=\"/x', page_id, '?q=1#y\" title=q>1</a><a href=\"../z.html\"></a><img src=//c.d/i', page_id, '.png><a href=\"mailto:q\"></a><script src=\"./a/../j.js\"></script><a href=\"javascript:x()\"></a><a href=\"#top\">')"
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(H.links(F.expr(html), F.col("url")), " ").alias("links"))
