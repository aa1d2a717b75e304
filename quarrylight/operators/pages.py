"""One html tokenizer, and what is read off its tokens: forms with defaults, calls in scripts, contexts of reflected text.

`tokens` runs in Arrow batches, a page at a time, and gives rows; everything behind it is joins and windows over them. Nothing of a page
is executed, and nothing inside a comment, a quoted attribute or a raw-text element is taken for markup.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.operators.intervals import dealt
from quarrylight.session import settle, workers_find_us

# fixed values: elements whose content is text up to their closing tag, script types that run, names of protection fields
RAW_TEXT = ("script", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "plaintext")
SCRIPT_TYPES = ("", "module", "text/javascript", "application/javascript")
FORM_TAGS = ("form", "input", "select", "option", "textarea")
CSRF_NAMES = ("csrf", "xsrf", "requestverificationtoken", "authenticity_token")
STATE_CHANGING = ("POST", "PUT", "PATCH", "DELETE")
CALL_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
#: bytes of a field's name, of its default value and of an option's text, beyond which they are left out
NAME_BYTES, VALUE_BYTES, OPTION_BYTES = 256, 2048, 256

# ------------------------------------------------------------------ tokenizer

_IN_TAG = re.compile(r"""(?:[^"'>]+|"[^"]*"|'[^']*')*""")
_NAME = re.compile(r"[^ \t\n\f\r/>]*")
_ATTRIBUTE = re.compile(r"""([^ \t\n\f\r=<>/][^ \t\n\f\r=>/]*)(?:[ \t\n\f\r]*=[ \t\n\f\r]*(?:"([^"]*)"?|'([^']*)'?|([^ \t\n\f\r>]*)))?""")
_ENDS = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW_TEXT if name != "plaintext"}


def _attributes(inside: str) -> list[tuple[str, str | None]]:
    """First value by lower-case name; null for names that have none."""
    out: dict[str, str | None] = {}
    for m in _ATTRIBUTE.finditer(inside):
        name, values = m[1].lower(), [v for v in m.groups()[1:] if v is not None]
        if out.get(name) is None:
            out[name] = values[0].strip() if values else out.get(name)
    return list(out.items())


def tokenize(html: str) -> Iterator[tuple[str, str, list, int, int]]:
    """(kind, tag, attributes, start, stop) in order; kinds: text, comment, open, close, raw (a raw-text element's content), broken.

    A tag goes to its first > outside quotes; one without, and a comment without its end, go to the end of the page.
    """
    at, size = 0, len(html)
    while at < size:
        less = html.find("<", at)
        less = size if less < 0 else less
        if less > at:
            yield "text", "", [], at, less
        at = less
        if html.startswith("<!--", at):
            stop = html.find("-->", at + 4)
            stop = size if stop < 0 else stop + 3
            yield "comment", "", [], at, stop
            at = stop
        elif at < size:
            more = _IN_TAG.match(html, at + 1).end()
            closing = html.startswith("/", at + 1)
            name = _NAME.match(html, at + 1 + closing, max(more, at + 1))
            tag = name[0].lower()
            if more >= size or html[more] != ">":
                yield "broken", tag, [], at, size
                return
            stop = more + 1
            yield ("close", tag, [], at, stop) if closing else ("open", tag, _attributes(html[name.end() : more]), at, stop)
            at = stop
            if not closing and tag in RAW_TEXT:
                end = _ENDS[tag].search(html, at) if tag in _ENDS else None
                stop = end.start() if end else size
                if stop > at:
                    yield "raw", tag, [], at, stop
                at = stop


_TOKENS = "place int, kind string, tag string, attributes map<string,string>, start int, stop int, text string"


def _tokens(batches: Iterator[pa.RecordBatch], tags: tuple[str, ...] | None = None) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.int32(), pa.string()]
    for b in batches:
        for i, page in enumerate(b.column("html")):
            html = page.as_py() or ""
            rows, before = [], ""
            for n, (k, t, a, x, y) in enumerate(tokenize(html)):
                if tags is None or t in tags or (k == "text" and before in tags):
                    rows.append((n, k, t, a, x, y, html[x:y] if k in ("text", "raw") else None))
                before = t
            for r in range(0, len(rows), 1 << 14):
                part = rows[r : r + (1 << 14)]
                ids = pa.repeat(b.column("id")[i], len(part))
                yield pa.record_batch([ids, *[pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)]], names=["id", "place", "kind", "tag", "attributes", "start", "stop", "text"])


def tokens(pages: DataFrame, tags: tuple[str, ...] | None = None) -> DataFrame:
    """Tokens of pages(id, html): id, place, kind, tag (lower case), attributes, start, stop (characters), text of text and raw tokens.

    Null or empty html has none. Ids must be unique where tokens are put together by id. With tags, only tokens of these and texts
    right behind one are given; places stay those of all tokens.
    """
    workers_find_us(pages.sparkSession)
    rows = pages.select("id", "html")
    return rows.mapInArrow(partial(_tokens, tags=tags), f"id {rows.schema['id'].dataType.simpleString()}, {_TOKENS}")


# ------------------------------------------------------------------ forms


def _bounded(value: Column, most: int = VALUE_BYTES) -> Column:
    return F.when(F.octet_length(value) <= most, value)


def _plain(text: Column, most: int) -> Column:
    """A control's text; none if it is long or holds markup or entities."""
    body = F.trim(F.regexp_replace(text, r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", ""))
    return F.when((F.octet_length(body) <= most) & ~body.rlike("[<&]"), body)


def forms(found: DataFrame) -> DataFrame:
    """Forms of tokens: id, place, action, method, parameters, hidden, protected (sorted names), defaults map<name, value>.

    A form goes to the first closing tag behind it; one without is none, and forms inside forms are part of them. Disabled
    controls, buttons, and names that are empty or very long are left out. Hidden, file, checkbox and radio fields and multiple
    selects are protected. Defaults: an input's value (of a checkbox or radio only if it is checked, else "on"), a select's selected or
    first enabled option, a textarea's text; of controls with one name the last of inputs, then selects, then textareas counts.
    action is as written, null if there is none; method is in upper case, GET if there is none. Of tokens, those of FORM_TAGS with
    the texts behind them suffice. They are written once and dealt by page over as many tasks as they need.
    """
    found = settle(found.filter(F.col("tag").isin(*FORM_TAGS) | (F.col("kind") == "text")), "tokens")
    found = dealt(found, ["id"], found)
    w = Window.partitionBy("id").orderBy("place")
    far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    attr = lambda n: F.try_element_at("attributes", F.lit(n))
    has = lambda n: F.coalesce(F.map_contains_key("attributes", F.lit(n)), F.lit(False))
    mark = lambda tag: F.when((F.col("tag") == tag) & F.col("kind").isin("open", "close"), F.col("kind"))

    def inside(df: DataFrame, tag: str, name: str) -> DataFrame:
        """df with `name`: the place of the element `tag` around each token, from an opening that no element holds to the first closing."""
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        event = df.withColumn("_e", mark(tag))
        event = event.withColumn("_was", F.last("_e", ignorenulls=True).over(before))
        begins = (F.col("_e") == "open") & (F.coalesce(F.col("_was"), F.lit("close")) == "close")
        event = event.withColumns({"_from": F.last(F.when(begins, F.col("place")), ignorenulls=True).over(far), "_end": F.last(F.when(F.col("_e") == "close", F.col("place")), ignorenulls=True).over(far), "_next": F.first(F.when(F.col("_e") == "close", F.col("place")), ignorenulls=True).over(rest)})
        open_ = (F.col("_from") > F.coalesce(F.col("_end"), F.lit(-1))) & F.col("_next").isNotNull()
        return event.withColumn(name, F.when(open_, F.col("_from"))).drop("_e", "_was", "_from", "_end", "_next")

    # only what forms are made of goes on: their marks, controls, options, and a text right behind an option
    behind = (F.lag("tag").over(w) == "option") & (F.lag("place").over(w) == F.col("place") - 1)
    wanted = F.col("tag").isin(*FORM_TAGS) | ((F.col("kind") == "text") & behind)
    kept = found.withColumn("_w", wanted).filter(F.coalesce("_w", F.lit(False))).drop("_w")
    placed = inside(inside(kept, "form", "form"), "select", "_select").filter(F.col("form").isNotNull())
    # a textarea's or option's text is the token behind its opening tag
    following = F.when(F.lead("kind").over(w).isin("text", "raw") & (F.lead("start").over(w) == F.col("stop")), F.lead("text").over(w)).otherwise("")
    placed = placed.withColumn("_text", following)

    named = ~has("disabled") & (F.length(attr("name")) > 0) & (F.octet_length(attr("name")) <= NAME_BYTES)
    kind = F.lower(F.coalesce(attr("type"), F.lit("text")))
    checks = kind.isin("checkbox", "radio")
    value = F.when(checks, F.when(has("checked"), F.coalesce(_bounded(attr("value")), F.lit("on")))).when(kind != "file", _bounded(attr("value")))
    inputs = placed.filter((F.col("kind") == "open") & (F.col("tag") == "input") & named & ~kind.isin("submit", "reset", "button", "image")).select(
        "id", "form", F.lit(0).alias("rank"), "place", attr("name").alias("name"), (kind == "hidden").alias("hidden"), (kind.isin("hidden", "file") | checks).alias("protected"), value.alias("value")
    )
    areas = placed.filter((F.col("kind") == "open") & (F.col("tag") == "textarea") & named).select(
        "id", "form", F.lit(2).alias("rank"), "place", attr("name").alias("name"), F.lit(False).alias("hidden"), F.lit(False).alias("protected"), _plain(F.col("_text"), VALUE_BYTES).alias("value")
    )
    worth = F.coalesce(_bounded(attr("value")), _plain(F.col("_text"), OPTION_BYTES))
    choice = F.struct((~has("selected")).alias("later"), F.col("place"), worth.alias("value"))
    picked = placed.filter((F.col("kind") == "open") & (F.col("tag") == "option") & F.col("_select").isNotNull() & ~has("disabled") & worth.isNotNull())
    picked = picked.groupBy("id", F.col("_select").alias("place")).agg(F.min(choice)["value"].alias("_picked"))
    selects = placed.filter((F.col("kind") == "open") & (F.col("tag") == "select") & (F.col("place") == F.col("_select")) & named).join(picked, ["id", "place"], "left").select(
        "id", "form", F.lit(1).alias("rank"), "place", attr("name").alias("name"), F.lit(False).alias("hidden"), has("multiple").alias("protected"), F.when(~has("multiple"), F.col("_picked")).alias("value")
    )
    controls = inputs.unionByName(selects).unionByName(areas)
    by_name = controls.groupBy("id", "form", "name").agg(F.bool_or("hidden").alias("hidden"), F.bool_or("protected").alias("protected"), F.max(F.when(F.col("value").isNotNull(), F.struct("rank", "place", "value")))["value"].alias("value"))
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("name"))))
    fields = by_name.groupBy("id", "form").agg(
        names(F.lit(True)).alias("parameters"), names(F.col("hidden")).alias("hidden"), names(F.col("protected")).alias("protected"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("name", "value"))))).alias("defaults"),
    )
    none = F.array().cast("array<string>")
    heads = placed.filter(F.col("place") == F.col("form")).select("id", "form", attr("action").alias("action"), F.upper(F.coalesce(attr("method"), F.lit("GET"))).alias("method"))
    out = heads.join(fields, ["id", "form"], "left")
    return out.select("id", F.col("form").alias("place"), "action", "method", *[F.coalesce(c, none).alias(c) for c in ("parameters", "hidden", "protected")], F.coalesce("defaults", F.map_from_entries(F.array().cast("array<struct<name:string,value:string>>"))).alias("defaults"))


def unprotected_forms(found: DataFrame) -> DataFrame:
    """Of forms() those that change state and have no hidden field named like a known protection."""
    known = F.exists("hidden", lambda h: F.lower(h).rlike("|".join(CSRF_NAMES)))
    return found.filter(F.col("method").isin(*STATE_CHANGING) & ~known)


# ------------------------------------------------------------------ scripts

_SCRIPT = re.compile(
    r"""//[^\n]*|/\*.*?\*/|[ \t\n\f\r]+|(?P<quoted>'[^'\\]*(?:\\.[^'\\]*)*'|"[^"\\]*(?:\\.[^"\\]*)*"|`[^`\\]*(?:\\.[^`\\]*)*`)|(?P<word>[A-Za-z_$][A-Za-z0-9_$]*)|(?P<symbol>[^/'"`])""",
    re.S,
)
_CONTINUES = ("await", "return", "yield")


def lex(source: str) -> list[tuple[str, str]] | None:
    """(kind, text) of a script's words, symbols and literals; strings with escapes, and templates, are opaque.

    None where the script can't be cut without a grammar: a slash that may divide or start a pattern, an open string or comment.
    """
    out, at = [], 0
    while at < len(source):
        m = _SCRIPT.match(source, at)
        if not m:
            return None
        if m.lastgroup == "quoted":
            inside = m["quoted"][1:-1]
            out.append(("opaque", "") if m["quoted"][0] == "`" or "\\" in inside or len(inside.encode()) > VALUE_BYTES else ("literal", inside))
        elif m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


def calls(source: str) -> list[tuple[str, str]]:
    """(method, target) of fetch and axios calls whose only argument is a literal, or whose options name a method and nothing else; each once."""
    found = lex(source) or []
    at = lambda i: found[i] if 0 <= i < len(found) else ("", "")
    symbols = lambda i, text: all(at(i + k) == ("symbol", c) for k, c in enumerate(text))
    out: dict[tuple[str, str], None] = {}
    for i, (kind, name) in enumerate(found):
        if kind != "word" or name not in ("fetch", "axios"):
            continue
        free = at(i - 1) != ("symbol", ".") and (at(i - 1)[0] != "word" or at(i - 1)[1] in _CONTINUES)
        of_window = at(i - 1) == ("symbol", ".") and at(i - 2) in (("word", "window"), ("word", "globalThis")) and at(i - 3) != ("symbol", ".")
        if name == "fetch":
            start, method = (i + 1, "GET") if free or of_window else (None, "")
        else:
            verb = at(i + 2)
            start, method = (i + 3, verb[1].upper()) if free and symbols(i + 1, ".") and verb[0] == "word" and verb[1].islower() else (None, "")
        if start is None or method not in CALL_METHODS or not symbols(start, "(") or at(start + 1)[0] != "literal":
            continue
        target, after = at(start + 1)[1], start + 2
        if not symbols(after, ")"):
            key, value = at(after + 2), at(after + 4)
            whole = name == "fetch" and symbols(after, ",{") and key[0] in ("word", "literal") and key[1] == "method" and symbols(after + 3, ":") and value[0] == "literal" and symbols(after + 5, "})")
            method = value[1].upper() if whole else ""
        if target and method in CALL_METHODS:
            out[method, target] = None
    return list(out)


def _calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, p, n, m, t) for i, p, s in zip(*(b.column(c).to_pylist() for c in ("id", "place", "text")), strict=True) for n, (m, t) in enumerate(calls(s or ""))]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        types = [b.schema.field("id").type, pa.int32(), pa.int32(), pa.string(), pa.string()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "place", "ordinal", "method", "target"])


def script_calls(found: DataFrame) -> DataFrame:
    """Calls in inline scripts of tokens: id, place, ordinal, method, target. Scripts of a type that does not run are left out."""
    w = Window.partitionBy("id").orderBy("place")
    kind = F.lower(F.coalesce(F.try_element_at(F.lag("attributes").over(w), F.lit("type")), F.lit("")))
    code = found.filter("tag = 'script'").withColumn("_type", kind).filter((F.col("kind") == "raw") & F.col("_type").isin(*SCRIPT_TYPES)).select("id", "place", "text")
    return code.mapInArrow(_calls, f"id {found.schema['id'].dataType.simpleString()}, place int, ordinal int, method string, target string")


def script_sources(found: DataFrame) -> DataFrame:
    """id, place, source of scripts that are loaded."""
    source = F.try_element_at("attributes", F.lit("src"))
    return found.filter("kind = 'open' AND tag = 'script'").select("id", "place", source.alias("source")).filter(F.length("source") > 0)


# ------------------------------------------------------------------ reflected text


def reflection_contexts(pages: DataFrame) -> DataFrame:
    """pages(id, html, marker): id, context in which the marker first stands: markup, attribute, script or inert.

    Inside a tag, also one without an end: attribute. Inside a script that runs: script. Inside a comment, another script, or another
    raw-text element, and where the marker does not occur: inert. A marker that begins a tag stands before it: markup.
    """
    w = Window.partitionBy("id").orderBy("place")
    kind = F.lower(F.coalesce(F.try_element_at(F.lag("attributes").over(w), F.lit("type")), F.lit("")))
    found = tokens(pages).withColumn("_type", F.when(F.col("kind") == "raw", kind)).filter("kind <> 'text'").select("id", "kind", "tag", "start", "stop", "_type")
    at = pages.select("id", (F.instr("html", F.col("marker")) - 1).alias("_at"))
    runs = (F.col("tag") == "script") & F.col("_type").isin(*SCRIPT_TYPES)
    where = F.when(F.col("kind") == "raw", F.when(runs, "script").otherwise("inert")).when(F.col("kind") == "comment", "inert").otherwise("attribute")
    holds = (F.col("_at") < F.col("stop")) & F.when(F.col("kind") == "raw", F.col("_at") >= F.col("start")).otherwise(F.col("_at") > F.col("start"))
    hit = found.join(at, "id").filter(holds).select("id", where.alias("_c"))  # tokens don't overlap: at most one
    out = at.join(hit, "id", "left")
    return out.select("id", F.when(F.coalesce(F.col("_at"), F.lit(-1)) < 0, "inert").otherwise(F.coalesce("_c", F.lit("markup"))).alias("context"))
