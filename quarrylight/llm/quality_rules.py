"""Quality rules with robust multivariate outliers, in DataFrame functions only.

`text_statistics` derives per-document counts. `mcd_distances` estimates, for every language and source, a minimum
covariance determinant (MCD) location and scatter of transformed statistics: from several starts, concentration steps go on
until no determinant falls, and the estimate of the lowest determinant is taken, scaled to be consistent for normal data.
Location and scatter are estimated again from all documents within the cutoff, and `quality_rules` rejects documents whose
squared Mahalanobis distance is over it. Variances are the estimates; a guard stands in only where an estimate is smaller, as
where nearly no document of a pool holds a symbol.

Defined results. Null or empty text: no words, every count 0, base rule failed. Null lang or source: a group of its own.
Sources with under `min_group` documents of a language, too few for a scatter of their own, are estimated together, and rests
of languages under it likewise. Repeated rows count as often as they occur; rows with equal statistics get equal distances.
Columns of the input that are not needed are not read; statistics are returned under the names below. An empty table gives
none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.session import release, settle

SPACE = r"[ \t\n\x0B\f\r]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: words, characters and lines at which a document's own statistics count half: averages over few units scatter more
HALF_WORDS, HALF_CHARS, HALF_LINES = 400, 200, 10
#: transformed statistics and a guard: the least standard deviation of each, for pools whose core has none at all
FEATURES: dict[str, tuple[Callable[[], Column], float]] = {
    "x_word": (lambda: F.log(F.lit(1.0) + F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))), 0.005),
    "x_symbol": (lambda: F.log(F.lit(0.02) + F.col("n_symbols") / (F.col("word_chars") + F.lit(HALF_CHARS))), 0.05),
    "x_lines": (lambda: F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + F.lit(HALF_LINES))), 0.06),
    "x_repeat": (lambda: F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + F.lit(HALF_WORDS))), 0.06),
}
#: 99.999 % quantile of chi-squared with four degrees of freedom, a fixed value
CUTOFF = 28.47


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """let value in body: evaluates value once inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """How many words lie in a WINDOW-word window that occurs twice or more.

    Windows are hashed to 64 bits from their words' hashes. Texts without an equal pair of hashes, most of them, stop
    there. Else the places of equal windows come from the short list of repeated hashes, or for texts that repeat a lot
    from one sort of (hash, place).
    """
    size = F.size(words) - (WINDOW - 1)

    def windows(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))

    def by_list(hashes: Column, repeated: Column) -> Column:
        marked = F.transform(hashes, lambda h, i: F.when(F.array_contains(repeated, h), i.cast("int")))
        return F.filter(marked, lambda i: i.isNotNull())

    def by_sort(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i"))))

        def places(s: Column) -> Column:
            twin = F.filter(
                s,
                lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        return bound(pairs, places)

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def repeats(hashes: Column) -> Column:
        twice = bound(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.get(s, k + 1) == x)))
        at = bound(twice, lambda r: F.when(F.size(r) <= 24, by_list(hashes, r)).otherwise(by_sort(hashes)))
        return bound(at, covered)

    hashes = F.slice(bound(F.transform(words, lambda w: F.xxhash64(w)), windows), F.lit(1), size)
    counted = bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeats(h)))
    return F.when(size < 2, F.lit(0)).otherwise(counted)


def text_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(*keep, body.alias("_body"), F.array_remove(F.split(body, SPACE), "").alias("_words"))
    lines = F.filter(F.split("_body", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    base = base.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        _repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
    )
    return base.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def consistency(share: float) -> float:
    """Factor that makes the scatter of the innermost `share` of normal data, in four dimensions, that of all of it."""
    inside = lambda x, terms: 1 - exp(-x / 2) * sum((x / 2) ** k / factorial(k) for k in range(terms))
    low, high = 0.0, 200.0
    for _ in range(200):  # the quantile by bisection
        middle = (low + high) / 2
        low, high = (middle, high) if inside(middle, 2) < share else (low, middle)
    return share / inside(low, 3)


def _facts(xs: list[str], s: int) -> list[str]:
    return [f"det{s}", *[f"m{s}_{x}" for x in xs], *[f"l{s}_{i}_{j}" for i in range(len(xs)) for j in range(i + 1)]]


def _moments(xs: list[str], weight: str, s: int) -> list[str]:
    """Means m and mean products p of the rows that weight, a condition, lets in."""
    out = [f"avg(CASE WHEN {weight} THEN {x} END) AS m{s}_{x}" for x in xs]
    return out + [f"avg(CASE WHEN {weight} THEN {x} * {y} END) AS p{s}_{x}_{y}" for i, x in enumerate(xs) for y in xs[: i + 1]]


def _cholesky(xs: list[str], floors: list[float], s: int, scale: float) -> list[str]:
    """The factor l of the scatter times scale, an element after the other; a variance under its floor's square is replaced by that."""
    out = []
    for i, x in enumerate(xs):
        for j, y in enumerate(xs[: i + 1]):
            c = f"(p{s}_{x}_{y} - m{s}_{x} * m{s}_{y}) * {scale!r}D"
            c = f"greatest({c}, {floors[i] ** 2!r}D)" if i == j else c
            c += "".join(f" - l{s}_{i}_{k} * l{s}_{j}_{k}" for k in range(j))
            out.append(f"sqrt(greatest({c}, {floors[i] ** 2 / 4!r}D)) AS l{s}_{i}_{j}" if i == j else f"({c}) / l{s}_{j}_{j} AS l{s}_{i}_{j}")
    return [*out, "2 * (" + " + ".join(f"ln(l{s}_{i}_{i})" for i in range(len(xs))) + f") AS det{s}"]


def _estimate(rows: DataFrame, xs: list[str], floors: list[float], weights: list[str], scale: float = 1.0) -> DataFrame:
    """Per pool and start s: means m, Cholesky factor l of the scatter times scale, log determinant det."""
    moments = [F.expr(e) for s, w in enumerate(weights) for e in _moments(xs, w, s)]
    df = rows.groupBy("_pool").agg(*moments).fillna(0.0)
    starts = range(len(weights))
    return df.selectExpr("*", *[e for s in starts for e in _cholesky(xs, floors, s, scale)]).select("_pool", *[c for s in starts for c in _facts(xs, s)])


def _distances(df: DataFrame, xs: list[str], names: list[str]) -> DataFrame:
    """df with the squared Mahalanobis distance under each start's estimate, by forward substitution."""
    out = []
    for s, name in enumerate(names):
        for i, x in enumerate(xs):
            out.append(f"({x} - m{s}_{x}" + "".join(f" - l{s}_{i}_{k} * _z{s}_{k}" for k in range(i)) + f") / l{s}_{i}_{i} AS _z{s}_{i}")
        out.append(" + ".join(f"_z{s}_{i} * _z{s}_{i}" for i in range(len(xs))) + f" AS {name}")
    return df.selectExpr("*", *out).select(*df.columns, *names)


def mcd_distances(stats: DataFrame, cutoff: float = CUTOFF, share: float = 0.75, min_group: int = 100) -> DataFrame:
    """stats with a column distance. stats must be cheap to read again (settled): each step reads it twice.

    Starts: the rows nearest the pool's medians by summed gaps in units of the guards, the same in units of the pool's
    median gaps, and all rows. Each concentration step is one grouped aggregate for the `share` quantile of the distances and
    one for the moments of the rows below it, for all starts at once; both combine map-side, so a language or source that
    holds most rows is no bottleneck. Quantiles and estimates, one row a pool, are settled before they are joined back, so
    the optimizer knows their size and broadcasts them while they are small; they go when the next step's are written. Steps
    end when no determinant falls by over 1 % (the quantiles' own error); guards bound it, so they do end.
    """
    xs, floors = list(FEATURES), [f for _, f in FEATURES.values()]
    quantile = lambda c, q: F.percentile_approx(c, q, 1000)
    by_pool = lambda df, *aggregates: settle(df.groupBy("_pool").agg(*aggregates), "quantiles")
    pooled, pools = _pooled(stats, min_group)
    first = settle(pooled.withColumns({x: f() for x, (f, _) in FEATURES.items()}), "features")
    release(pools)
    # a mean word length counts from its pool's median, the less the fewer words it is a mean of
    weight = F.sqrt(F.col("n_words") / (F.col("n_words") + F.lit(HALF_WORDS)))
    middle = by_pool(first, quantile("x_word", 0.5).alias("_middle"))
    rows = settle(first.join(middle, "_pool").withColumn("x_word", (F.col("x_word") - F.col("_middle")) * weight).drop("_middle"), "features", first)

    medians = by_pool(rows, *[quantile(x, 0.5).alias(f"d_{x}") for x in xs])
    gaps = {x: F.abs(F.col(x) - F.col(f"d_{x}")) for x in xs}
    near = rows.join(medians, "_pool")
    spread = by_pool(near, *[quantile(gaps[x], 0.5).alias(f"u_{x}") for x in xs])
    near = near.join(spread, "_pool")
    summed = lambda units: reduce(lambda a, b: a + b, [gaps[x] / u for x, u in zip(xs, units, strict=True)])
    near = near.withColumns({"_g0": summed([F.lit(f) for f in floors]), "_g1": summed([F.greatest(F.col(f"u_{x}"), F.lit(f)) for x, f in zip(xs, floors, strict=True)])})
    limits = by_pool(near, *[quantile(g, share).alias(f"_limit{g}") for g in ("_g0", "_g1")])
    now = settle(_estimate(near.join(limits, "_pool"), xs, floors, ["_g0 <= _limit_g0", "_g1 <= _limit_g1", "true"]), "mcd")
    release(middle, medians, spread, limits)
    starts, names = range(3), ["_d0", "_d1", "_d2"]
    while True:
        at = _distances(rows.join(now, "_pool"), xs, names)
        limit = by_pool(at, *[quantile(d, share).alias(f"_limit{d}") for d in names])
        new = _estimate(at.join(limit, "_pool"), xs, floors, [f"{d} <= _limit{d}" for d in names])
        j = now.join(new.select("_pool", *[F.col(c).alias(f"_{c}") for s in starts for c in _facts(xs, s)]), "_pool")
        lower = {s: f"_det{s} < det{s} - 0.01D" for s in starts}
        # a start that has settled in a pool keeps its estimate there, so its determinant never rises and falls again
        kept = [f"CASE WHEN {lower[s]} THEN _{c} ELSE {c} END AS {c}" for s in starts for c in _facts(xs, s)]
        step = settle(j.selectExpr("_pool", *kept, f"({' OR '.join(lower.values())}) AS _moved"), "mcd", now)
        release(limit)
        now = step
        if now.filter("_moved").isEmpty():
            break
    best = "least(" + ", ".join(f"det{s}" for s in starts) + ")"
    pick = lambda k: f"CASE {' '.join(f'WHEN det{s} = {best} THEN {_facts(xs, s)[k]}' for s in starts)} END AS {_facts(xs, 0)[k]}"
    raw = settle(now.selectExpr("_pool", *[pick(k) for k in range(len(_facts(xs, 0)))]), "mcd", now)
    within = _distances(rows.join(raw, "_pool"), xs, ["_raw"])
    final = settle(_estimate(within, xs, floors, [f"_raw <= {cutoff * consistency(share)!r}D"]), "mcd", raw)
    return _distances(rows.join(final, "_pool"), xs, ["distance"])


def _pooled(stats: DataFrame, min_group: int) -> tuple[DataFrame, DataFrame]:
    """(stats with _pool: its language and source; small sources of a language together; small rests of languages together; the settled pools)."""
    keys = {"_lang": F.coalesce("lang", F.lit("\0")), "_source": F.coalesce("source", F.lit("\0"))}
    counts = settle(stats.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count(F.lit(1)).alias("_n")), "pools")
    rest = counts.filter(F.col("_n") < min_group).groupBy("_lang").agg(F.sum("_n").alias("_rest"))
    pools = settle(counts.join(rest, "_lang", "left").select(
        "_lang",
        "_source",
        F.when(F.col("_n") >= min_group, F.to_json(F.struct("_lang", "_source")))
        .when(F.col("_rest") >= min_group, F.to_json(F.struct("_lang")))
        .otherwise(F.lit("{}"))
        .alias("_pool"),
    ), "pools", counts)
    return stats.withColumns(keys).join(pools, ["_lang", "_source"]).drop("_lang", "_source"), pools


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF, **mcd) -> DataFrame:
    """One row per document: statistics, base_failed, distance and kept."""
    stats = settle(text_statistics(docs), "statistics")
    out = mcd_distances(stats, cutoff, **mcd).withColumn("base_failed", base_failed())
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("distance") <= F.lit(cutoff))).alias("kept"), "distance",
    )
