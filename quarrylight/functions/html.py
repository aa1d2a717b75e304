"""Links, API descriptions and response rules over html text, as regular expressions in the JVM. Forms and scripts: operators/pages.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.scalar import normalize_url, title_case

TAG = r"""(?is)(<(?:a|link|script|img|form)\b(?:[^>"']|"[^"]*"|'[^']*')*>)"""
ATTRIBUTE = r"""(?is)[\s"'](?:href|src|action)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>]+))"""


def link_targets(html: Column) -> Column:
    """Every href, src and action of a, link, script, img and form tags, as written."""
    of = lambda tag, k: F.regexp_extract_all(tag, F.lit(ATTRIBUTE), k)
    both = lambda a, b: F.concat(a, b)
    one = lambda tag: F.zip_with(F.zip_with(of(tag, 1), of(tag, 2), both), of(tag, 3), both)
    return F.transform(F.flatten(F.transform(F.regexp_extract_all(html, F.lit(TAG), 1), one)), lambda u: F.trim(u))


def _folded(path: Column) -> Column:
    """A path with . and .. folded; .. above the root stays there."""
    step = lambda a, s: F.when(s == ".", a).when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(s)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.array_join(parts, "/"), F.when(path.rlike(r"(^|/)\.{1,2}$"), "/").otherwise(""))


def links(html: Column, base: Column) -> Column:
    """Sorted distinct http(s) links of a, link, script, img and form tags, resolved against base; fragments go."""
    origin = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]+)", 1)
    bare = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.regexp_replace(bare, r"^([A-Za-z]+://[^/]+)?(/?.*?)[^/]*$", "$2")
    skip = r"(?i)^(#|javascript:|mailto:|data:|$)"

    def resolve(u: Column) -> Column:
        u = F.split_part(u, F.lit("#"), F.lit(1))
        path, query = F.split_part(u, F.lit("?"), F.lit(1)), F.regexp_extract(u, r"(\?.*)$", 1)
        rooted = F.when(u.startswith("/"), path).when(path == "", F.regexp_replace(bare, r"^[A-Za-z]+://[^/]+", "")).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
        full = F.when(u.rlike("(?i)^[a-z][a-z0-9+.-]*:"), u).when(u.startswith("//"), F.concat(F.split_part(base, F.lit("//"), F.lit(1)), u)).otherwise(F.concat(origin, _folded(rooted), query))
        return normalize_url(full)

    found = F.filter(link_targets(html), lambda u: ~u.rlike(skip))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, resolve), lambda u: u.rlike("^https?://"))))


_OPERATIONS = "map<string,struct<get:struct<parameters:array<struct<name:string,`in`:string>>>, post:struct<parameters:array<struct<name:string,`in`:string>>>, put:struct<parameters:array<struct<name:string,`in`:string>>>, patch:struct<parameters:array<struct<name:string,`in`:string>>>, delete:struct<parameters:array<struct<name:string,`in`:string>>>>>"
_METHODS = ["get", "post", "put", "patch", "delete"]


def openapi_operations(documents: DataFrame) -> DataFrame:
    """documents(base, body): url, method, parameters ("place:name", sorted) of every operation; bodies that are no such JSON give none.

    The first server's url stands before the paths, or base if there is none. References are not followed.
    """
    server = F.coalesce(F.get_json_object("body", "$.servers[0].url"), F.col("base"))
    paths = documents.select(server.alias("server"), F.explode(F.from_json(F.get_json_object("body", "$.paths"), _OPERATIONS)).alias("path", "ops"))
    ops = F.array_compact(F.array(*[F.when(F.col(f"ops.{m}").isNotNull(), F.struct(F.lit(m.upper()).alias("method"), F.col(f"ops.{m}.parameters").alias("p"))) for m in _METHODS]))
    rows = paths.select("server", "path", F.explode(ops).alias("o"))
    names = F.array_sort(F.transform(F.coalesce("o.p", F.array().cast("array<struct<name:string,`in`:string>>")), lambda p: F.concat(p["in"], F.lit(":"), p["name"])))
    return rows.select(F.concat(F.rtrim("server", F.lit("/")), "path").alias("url"), F.col("o.method").alias("method"), names.alias("parameters"))


def response_findings(status: Column, headers: Column, cookies: Column, body: Column, url: Column) -> Column:
    """array<string> of passive findings of a recorded response; header names are lower case."""
    has = lambda h: F.map_contains_key(headers, F.lit(h))
    value = lambda h: F.coalesce(F.try_element_at(headers, F.lit(h)), F.lit(""))
    https, page = url.startswith("https://"), F.contains(value("content-type"), F.lit("text/html"))
    lacks = lambda flag: F.exists(cookies, lambda c: ~F.contains(F.lower(c), F.lit(flag)))
    rules = {
        "missing_hsts": https & ~has("strict-transport-security"), "missing_csp": page & ~has("content-security-policy"),
        "missing_content_type_options": ~F.contains(F.lower(value("x-content-type-options")), F.lit("nosniff")),
        "missing_frame_protection": page & ~has("x-frame-options") & ~F.contains(value("content-security-policy"), F.lit("frame-ancestors")),
        "missing_referrer_policy": page & ~has("referrer-policy"), "cookie_without_secure": https & lacks("secure"), "cookie_without_httponly": lacks("httponly"),
        "cookie_without_samesite": lacks("samesite"), "cors_any_origin_with_credentials": (value("access-control-allow-origin") == "*") & (F.lower(value("access-control-allow-credentials")) == "true"),
        "server_version": value("server").rlike("[0-9]+[.][0-9]+") | has("x-powered-by"), "cacheable_with_cookie": (F.size(cookies) > 0) & ~F.lower(value("cache-control")).rlike("no-store|private"),
        "mixed_content": https & page & F.contains(F.lower(body), F.lit("http://")), "verbose_error": (status >= 500) & F.lower(body).rlike("traceback|stack trace|exception in|at [a-z.]+\\([a-z]+\\.java"),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))


def application_map(pages: DataFrame) -> DataFrame:
    """pages(url, html) by first path segment, title-cased: pages, and how many have a form, an API path, parameters, a sign-in path."""
    area = title_case(F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]*)", 1))
    return pages.groupBy(area.alias("area")).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.contains(F.lower("html"), F.lit("<form"))).alias("forms"), F.count_if(F.col("url").rlike(r"/api/|\.json")).alias("apis"),
        F.count_if(F.contains("url", F.lit("?"))).alias("parameters"), F.count_if(F.lower("url").rlike("login|signin|auth|account")).alias("auth"),
    )
