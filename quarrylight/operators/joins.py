"""Interval, pattern, probe and uniqueness joins.

Every one has an equality to partition by; intervals are residuals of that equi-join, or of an equality on fixed-width
buckets where one key has many intervals, so no plan falls back to a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.scalar import normalize_path


def dependencies_done(items: DataFrame, deps: DataFrame, key: str, done: str) -> DataFrame:
    """Items none of whose dependencies is unfinished (no dependency: ready)."""
    return items.join(deps.filter(~F.coalesce(F.col(done), F.lit(False))), key, "left_anti")


def buckets(start: Column, stop: Column, width: int) -> Column:
    """The width-wide buckets that [start, stop] touches."""
    return F.sequence(F.floor(start / width), F.floor(stop / width))


#: spans of up to 2**LEAST_CLASS places share one class
LEAST_CLASS = 6


def size_class(length: Column) -> Column:
    """k for spans of at most 2**k: spans of one class touch at most two buckets of 2**k, so no span is copied often.

    Short spans share the class LEAST_CLASS, so a point is not sent out for each of their sizes.
    """
    return F.greatest(F.lit(LEAST_CLASS), F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double")))).cast("int")


def _classed(spans: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(spans with _k and each bucket _b that they touch, the classes that a key has: at most one row a power of two)."""
    s = spans.withColumn("_k", size_class(F.col("hi") - F.col("lo")))
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_k"))).cast("long")
    return s.withColumn("_b", F.explode(F.sequence(at("lo"), at("hi")))), s.select(*keys, "_k").distinct()


#: up to so many classes in all, points go to each of them and need not be joined with those of their key
FEW_CLASSES = 2


def _placed(points: DataFrame, classes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """points once for every class of their key, with the bucket of `column` there; where there are few classes in all, once for each of those."""
    few = [x["_k"] for x in classes.select("_k").distinct().limit(FEW_CLASSES + 1).collect()]
    of_class = points.join(classes, keys) if len(few) > FEW_CLASSES else points.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in few]).cast("array<int>")))
    return of_class.withColumn("_b", F.floor(F.col(column) / F.pow(F.lit(2.0), F.col("_k"))).cast("long"))


def narrowest_container(points: DataFrame, spans: DataFrame, keys: list[str], point_id: str, span_id: str) -> DataFrame:
    """points(keys, point_id, start, stop) with the narrowest span(keys, span_id, lo, hi) that contains them.

    Ties go to the later lo, then the smaller id. unique says whether only one span has that width. Spans meet points in
    buckets of their own size, a point in one bucket of a class, so a span meets it once; of a point's spans only the best and
    the range of ids of its width are kept.
    """
    s, classes = _classed(spans, keys)
    hit = _placed(points, classes, keys, "start").join(s, [*keys, "_k", "_b"]).filter((F.col("lo") <= F.col("start")) & (F.col("stop") <= F.col("hi")))
    w, span = F.col("hi") - F.col("lo"), F.col(span_id)
    # of the narrowest: the best, the smallest id and the largest, in one aggregate
    best = hit.groupBy(*keys, point_id).agg(
        F.min(F.struct(w.alias("w"), (-F.col("lo")).alias("l"), span.alias("id"))).alias("m"), F.min(F.struct(w.alias("w"), span.alias("id"))).alias("a"), F.max(F.struct((-w).alias("w"), span.alias("id"))).alias("z")
    )
    return best.select(*keys, point_id, F.col("m.id").alias(span_id), F.col("m.w").alias("width"), (F.col("a.id") == F.col("z.id")).alias("unique"))


def overlaps(spans: DataFrame, keys: list[str], span_id: str, width: int = 64) -> DataFrame:
    """Pairs of spans(keys, span_id, lo, hi) of one key that overlap, left id < right id; each pair once, in its first shared bucket."""
    s = spans.withColumn("_b", F.explode(buckets(F.col("lo"), F.col("hi"), width)))
    a, b = s.alias("a"), s.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_b"]]
    first = F.col("a._b") == F.floor(F.greatest("a.lo", "b.lo") / width)
    residual = (F.col(f"a.{span_id}") < F.col(f"b.{span_id}")) & (F.col("a.lo") <= F.col("b.hi")) & (F.col("b.lo") <= F.col("a.hi")) & first
    on = residual
    for c in same:
        on = on & c
    return a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{span_id}").alias("left_id"), F.col(f"b.{span_id}").alias("right_id"))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def template_join(paths: DataFrame, templates: DataFrame, path_id: str, template_id: str) -> DataFrame:
    """paths(path_id, method, path) with the best template(template_id, method, template): exact beats placeholders.

    :x, {x} and <x> stand for one segment. Ties go to the template with more literal segments, then the smaller id.
    """
    p = paths.withColumn("_ps", segments(F.col("path"))).withColumn("_n", F.size("_ps"))
    t = templates.withColumn("_ts", segments(F.col("template"))).withColumn("_n", F.size("_ts")).withColumnRenamed("method", "_method")
    wild = lambda s: s.rlike(r"^(:.+|\{.+\}|<.+>)$")
    fits = F.forall(F.zip_with("_ts", "_ps", lambda a, b: wild(a) | (a == b)), lambda x: x)
    literal = F.size(F.filter("_ts", lambda s: ~wild(s)))
    hit = p.join(t, (F.col("method") == F.col("_method")) & (p["_n"] == t["_n"]) & fits)
    best = hit.groupBy(path_id).agg(F.max(F.struct(literal.alias("l"), (-F.col(template_id)).alias("i"), F.size("_ts").alias("n"))).alias("_b"))
    return best.select(path_id, (-F.col("_b.i")).alias(template_id), (F.col("_b.l") == F.col("_b.n")).alias("exact"))


def first_match(probes: DataFrame, targets: DataFrame, key: str, candidates: str, target: str) -> DataFrame:
    """probes(key, candidates array) with the first candidate that is a target, and its place."""
    rows = probes.select(key, F.posexplode(candidates).alias("place", target))
    hit = rows.join(targets.select(target).distinct(), target)
    best = hit.groupBy(key).agg(F.min(F.struct("place", target)).alias("_b"))
    return probes.select(key).join(best, key, "left").select(key, F.col(f"_b.{target}").alias(target), F.col("_b.place").alias("place"))


def resolve_unique(refs: DataFrame, names: DataFrame, keys: list[str], ref_id: str, target: str) -> DataFrame:
    """0 matches: unresolved, 1: resolved with its target, more: ambiguous."""
    counts = names.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(target).alias("_t"))
    j = refs.join(counts, keys, "left")
    state = F.when(F.col("_n").isNull(), "unresolved").when(F.col("_n") == 1, "resolved").otherwise("ambiguous")
    return j.select(ref_id, state.alias("state"), F.when(F.col("_n") == 1, F.col("_t")).alias(target))


def structural_parent(spans: DataFrame, keys: list[str], span_id: str) -> DataFrame:
    """The smallest strictly enclosing span of each span (null: none). Enclosing spans are met in buckets of their own size."""
    s, classes = _classed(spans.select(*keys, F.col(span_id).alias("_id"), "lo", "hi"), keys)
    inner = _placed(spans.select(*keys, span_id, F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), classes, keys, "_lo")
    wider = (F.col("lo") <= F.col("_lo")) & (F.col("_hi") <= F.col("hi")) & ((F.col("hi") - F.col("lo")) > (F.col("_hi") - F.col("_lo")))
    best = inner.join(s, [*keys, "_k", "_b"]).filter(wider).groupBy(*keys, span_id).agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("w"), F.col("_id").alias("id"))).alias("_m"))
    return spans.select(*keys, span_id).distinct().join(best, [*keys, span_id], "left").select(*keys, span_id, F.col("_m.id").alias("parent_id"))


def adjacent(steps: DataFrame, run: str, position: str, columns: list[str]) -> DataFrame:
    w = Window.partitionBy(run).orderBy(position)
    return steps.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})


#: fixed values: what may follow an import's path, by language
CANDIDATE_ENDS = {
    "JavaScript": ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"],
    "Python": [".py", "/__init__.py"],
}


def import_candidates(source: Column, language: Column, specifier: Column) -> Column:
    """Paths that a relative import may mean, in the order they are tried; null for imports from outside, empty if the path leaves the root.

    Python's leading dots go up a folder each after the first.
    """
    folder = F.regexp_replace(source, "(^|/)[^/]*$", "")
    dots = F.length(F.regexp_extract(specifier, r"^(\.+)", 1))
    steps = F.concat(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), F.translate(F.regexp_replace(specifier, r"^\.+", ""), ".", "/"))
    base = normalize_path(F.concat(folder, F.when(folder == "", "").otherwise("/"), F.when(language == "Python", steps).otherwise(specifier)))
    ends = F.when(language == "Python", F.array(*map(F.lit, CANDIDATE_ENDS["Python"]))).otherwise(F.array(*map(F.lit, CANDIDATE_ENDS["JavaScript"])))
    inside = F.when(language == "Python", specifier.startswith(".")).otherwise(specifier.rlike(r"^\.\.?/"))
    return F.when(inside, F.transform(F.when(base.isNull(), F.array().cast("array<string>")).otherwise(ends), lambda e: F.concat(base, e)))


def resolve_bindings(routes: DataFrame, bindings: DataFrame, handlers: DataFrame) -> DataFrame:
    """routes(route_id, file, handler), bindings(file, ordinal, local, imported, target_file), handlers(file, name, handler_id): route_id, handler_id, state.

    The first binding of the local name counts. A named import means the handler of that name in the target file; default and
    * mean its only handler. state: resolved, ambiguous (several handlers under default or *), unresolved or unbound.
    """
    first = bindings.groupBy("file", F.col("local").alias("handler")).agg(F.min(F.struct("ordinal", "imported", "target_file")).alias("b"))
    bound = routes.join(first, ["file", "handler"], "left").select("route_id", F.col("b.imported").alias("imported"), F.col("b.target_file").alias("target_file"))
    whole = F.col("imported").isin("default", "*")
    named = handlers.groupBy(F.col("file").alias("target_file"), F.col("name").alias("imported")).agg(F.min("handler_id").alias("_named"))
    only = handlers.groupBy(F.col("file").alias("target_file")).agg(F.min("handler_id").alias("_only"), F.countDistinct("handler_id").alias("_n"))
    j = bound.join(named, ["target_file", "imported"], "left").join(only, "target_file", "left")
    found = F.when(whole, F.when(F.col("_n") == 1, F.col("_only"))).otherwise(F.col("_named"))
    state = F.when(F.col("imported").isNull(), "unbound").when(found.isNotNull(), "resolved").when(whole & (F.col("_n") > 1), "ambiguous").otherwise("unresolved")
    return j.select("route_id", found.alias("handler_id"), state.alias("state"))


def parameter_overlap(a: Column, b: Column) -> Column:
    """Names in both lists, whatever their case, sorted."""
    low = lambda x: F.transform(x, lambda v: F.lower(v))
    return F.array_sort(F.array_intersect(low(a), low(b)))
