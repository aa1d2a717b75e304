"""Forms, scripts and reflected text of pages: every page carries markup made of its own id and url, whose answer the SQL derives."""

from pyspark.sql import functions as F

from quarrylight.operators import pages as P
from quarrylight.registry import register
from quarrylight.session import table

_PATH = r"regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)"


def _with(spark, sf_dir, addition):
    """Pages as (id, html, ...) with html that goes on with the addition, a SQL expression of page_id and url."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat("html", F.expr(addition)).alias("html"))


@register("html_tokens", r"""WITH r AS (SELECT page_id, regexp_extract_all(html, '<!--.*?-->') AS c, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'g'), '<(script|title)>[^<]*(<[^/][^<]*|</p>[^<]*)*</', '<\1></', 'g') AS h FROM pages)
SELECT page_id, len(c) AS comments, len(regexp_extract_all(h, '<[^/>][^>]*>')) AS opens, len(regexp_extract_all(h, '</[^>]*>')) AS closes, len(regexp_extract_all(h, '<a ')) AS links FROM r""")  # fmt: skip
def html_tokens(spark, sf_dir):
    """What the tokenizer finds on every page."""
    kind = lambda k, more=F.lit(True): F.count_if((F.col("kind") == k) & more)
    t = P.tokens(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "html"))
    return t.groupBy(F.col("id").alias("page_id")).agg(kind("comment").alias("comments"), kind("open").alias("opens"), kind("close").alias("closes"), kind("open", F.col("tag") == "a").alias("links"))


_METHOD = "CASE page_id % 3 WHEN 0 THEN 'post' WHEN 1 THEN 'GET' ELSE 'Put' END"
_HIDDEN = "CASE page_id % 5 WHEN 0 THEN 'csrf_token' WHEN 1 THEN 'page_token' WHEN 2 THEN 'X-XSRF' WHEN 3 THEN 'nonce' ELSE '' END"
_FORM = rf"""concat('<!-- <form><input name=ghost></form> --><form title="a>b" action="', regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '" method=', {_METHOD}, '><input type=hidden name="', {_HIDDEN}, '" value=', page_id,
 '><input name=q value="1 > ', page_id, '"><input type=checkbox name=c', CASE WHEN page_id % 2 = 0 THEN ' checked' ELSE '' END, '><input type=submit name=go><select name=s><option value=a', page_id, '>x<option', CASE WHEN page_id % 2 = 0 THEN ' selected' ELSE '' END,
 '> b', page_id, ' </select><textarea name=note> hi ', page_id, ' </textarea></form><script>"<form method=post><input name=js></form>"</script><form method=post><input name=open')"""


@register("forms_found", f"""WITH f AS (SELECT page_id, {_PATH} AS action, upper({_METHOD}) AS method, {_HIDDEN} AS h FROM pages)
SELECT page_id, action, method, array_to_string(list_sort(list_filter([h, 'q', 'c', 's', 'note'], lambda x: x <> '')), ',') AS parameters, h AS hidden,
array_to_string(list_sort(list_filter([CASE WHEN h <> '' THEN h || '=' || page_id END, 'q=1 > ' || page_id, CASE WHEN page_id % 2 = 0 THEN 'c=on' END, CASE WHEN page_id % 2 = 0 THEN 's=b' || page_id ELSE 's=a' || page_id END, 'note=hi ' || page_id], lambda x: x IS NOT NULL)), ',') AS defaults FROM f""")  # fmt: skip
def forms_found(spark, sf_dir):
    """Forms with their defaults, past comments, scripts, quoted attributes and a form without an end."""
    f = P.forms(P.tokens(_with(spark, sf_dir, _FORM), P.FORM_TAGS))
    pairs = F.array_sort(F.transform(F.map_entries("defaults"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return f.select(F.col("id").alias("page_id"), "action", "method", F.array_join("parameters", ",").alias("parameters"), F.array_join("hidden", ",").alias("hidden"), F.array_join(pairs, ",").alias("defaults"))


@register("forms_without_token", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'POST' ELSE 'PUT' END AS method FROM pages WHERE page_id % 3 <> 1 AND page_id % 5 NOT IN (0, 2)")
def forms_without_token(spark, sf_dir):
    """State-changing forms without a known protection: a page_token or nonce is none."""
    return P.unprotected_forms(P.forms(P.tokens(_with(spark, sf_dir, _FORM), P.FORM_TAGS))).select(F.col("id").alias("page_id"), "method")


_SCRIPTS = r"""concat('<script>// fetch("/c")\nfetch("/api/', page_id, '"); const s = "axios.get(1)"; /* fetch("/d") */ axios.', CASE WHEN page_id % 2 = 0 THEN 'post' ELSE 'put' END, '("', regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1),
 '"); fetch(`/t`); fetch("/o", {method: "DELETE"})', CASE WHEN page_id % 3 = 0 THEN '; var r = /fetch/' ELSE '' END, '</script><script type="text/template">fetch("/x")</script><script src=" /j', page_id, '.js "></script>')"""


@register("script_calls", f"""SELECT page_id, unnest(['GET', CASE WHEN page_id % 2 = 0 THEN 'POST' ELSE 'PUT' END, 'DELETE']) AS method, unnest(['/api/' || page_id, {_PATH}, '/o']) AS target FROM pages WHERE page_id % 3 <> 0""")
def script_calls(spark, sf_dir):
    """Calls of inline scripts that run; comments, strings, templates and scripts with a slash that may be a pattern give none."""
    return P.script_calls(P.tokens(_with(spark, sf_dir, _SCRIPTS))).select(F.col("id").alias("page_id"), "method", "target")


@register("script_sources", "SELECT page_id, '/j' || page_id || '.js' AS source FROM pages")
def script_sources(spark, sf_dir):
    return P.script_sources(P.tokens(_with(spark, sf_dir, _SCRIPTS))).select(F.col("id").alias("page_id"), "source")


_BEFORE = """CASE page_id % 9 WHEN 0 THEN '<p>' WHEN 1 THEN '<a title="x>y ' WHEN 2 THEN '<script>var a="' WHEN 3 THEN '<script type="text/template">' WHEN 4 THEN '<iframe>' WHEN 5 THEN '<style>' WHEN 6 THEN '<!-- ' WHEN 7 THEN '<script type=module>1</script><b ' ELSE '<textarea></p>' END"""


@register("reflection_contexts", "SELECT page_id, CASE WHEN page_id % 10 = 9 THEN 'inert' ELSE ['markup', 'attribute', 'script', 'inert', 'inert', 'markup', 'inert', 'attribute', 'inert'][page_id % 9 + 1] END AS context FROM pages")
def reflection_contexts(spark, sf_dir):
    """Where a marker lands on every page; on one in ten it does not occur."""
    body = _with(spark, sf_dir, f"concat({_BEFORE}, CASE WHEN page_id % 10 = 9 THEN '' ELSE concat('mark', page_id, 'er') END)")
    return P.reflection_contexts(body.withColumn("marker", F.concat(F.lit("mark"), F.col("id").cast("string"), F.lit("er")))).select(F.col("id").alias("page_id"), "context")
