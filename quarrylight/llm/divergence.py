"""How far the sources of a language diverge in their vocabulary: relational operators only.

Terms are exploded regexp matches, counted by (lang, source, term). A language keeps the terms of at least `min_docs` of its
rows; its groups (sources) are joined with its kept terms, so that a term a group lacks counts zero, and a self-join on lang and
term sums the divergence of every two groups. Shares are integers out of SCALE with two added to every count:
p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)); a term's divergence of p from q is floor((p - q)^2 / (p + q)).

Scale. Counting combines map-side, so a source that holds a third of all rows sends one row per term and task. Everything behind
it is dealt by (lang, term): the dense table has groups of a language x its kept terms, which is what is asked for, and no two
documents ever meet. A group's best terms are cut to `top` in every task before they are ranked.

Defined results. Null text, lang or source is ''. Repeated rows, rows without an id and rows of one id count each by itself. A
text without terms still makes its group occur. A language without kept terms has pairs of value 0 and no terms. Ties go to the
item that is smaller in UTF-8. An empty table gives none. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.session import settle

#: terms are runs of [^\x00-\x40\x5B-\x60\x7B-\x7F], ASCII letters and everything beyond ASCII; this is what stands between them
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000


def _key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and rows with the term.

    The matches are what a split at everything else leaves: extracting them copies the whole text for each. A text's terms are
    sorted, so a term's first occurrence is where it differs from the one before; empty ends of the text come first and go.
    """
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    found = docs.select(_key("lang"), _key("source"), F.sort_array(F.split(low, BETWEEN)).alias("_t"))
    before = F.concat(F.array(F.lit("")), F.slice("_t", 1, F.size("_t") - 1))
    each = found.select("lang", "source", F.inline(F.arrays_zip(F.col("_t").alias("term"), before.alias("_before")))).filter("term <> ''")
    first = (F.col("term") != F.col("_before")).cast("long")
    return each.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.sum(first).alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), in decimals: the product may pass 64 bits."""
    top = (count + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, F.nullif(total + terms * 2, F.lit(0)).cast("decimal(29,0)")) + 1


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    groups = docs.select(_key("lang"), _key("source")).distinct()
    by_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns({"_docs": F.sum("docs").over(by_term), "_all": F.sum("n").over(by_term)})
    kept = settle(counts.filter(F.col("_docs") >= min_docs).select("lang", "source", "term", "n", "_all"), "kept")

    terms = kept.groupBy("lang", "term").agg(F.max("_all").alias("_all"))
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("_v"), F.sum("_all").alias("_lang_n"))
    filled = kept.groupBy("lang", "source").agg(F.sum("n").alias("_n"))
    groups = groups.join(filled, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = settle(groups.select("lang", "source", F.coalesce("_n", F.lit(0)).alias("_n"), F.coalesce("_v", F.lit(0)).alias("_v"), F.coalesce("_lang_n", F.lit(0)).alias("_lang_n")), "groups")

    # pair: every group gets every kept term of its language
    full = terms.select("lang", "term").join(groups.select("lang", "source", "_n", "_v"), "lang")
    dense = full.join(kept.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left")
    dense = settle(dense.select("lang", "term", "source", _share(F.coalesce("n", F.lit(0)), F.col("_n"), F.col("_v")).alias("p")), "dense")
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    met = dense.join(other, ["lang", "term"]).filter(F.col("source") < F.col("item"))
    half = met.groupBy("lang", "source", "item").agg(F.sum(_divergence(F.col("p"), F.col("q"))).alias("value"))
    both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").filter(F.col("source") != F.col("item"))
    pairs = pairs.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    # term: of what a group has itself
    own = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", _share(F.col("n"), F.col("_n"), F.col("_v")).alias("p"), _share(F.col("_all"), F.col("_lang_n"), F.col("_v")).alias("q")
    )
    over = own.filter(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _divergence(F.col("p"), F.col("q")).alias("value"))

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = over.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(best)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
  t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
  keep AS (SELECT lang, term, count(*)::HUGEINT AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
  g AS (SELECT DISTINCT lang, source FROM d),
  c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, source, term),
  dense AS (SELECT g.lang, g.source, keep.term, coalesce(c.n, 0)::HUGEINT AS n, total FROM g JOIN keep ON keep.lang = g.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = keep.term),
  v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS all_n FROM keep GROUP BY lang),
  s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM dense GROUP BY lang, source),
  p AS (SELECT dense.lang, dense.source, dense.term, dense.n, (1 + (1000000000 * (dense.n + 2)) // (s.n + 2 * v))::BIGINT AS p,
      (1 + (1000000000 * (total + 2)) // (all_n + 2 * v))::BIGINT AS q FROM dense JOIN s ON s.lang = dense.lang AND s.source = dense.source JOIN v ON v.lang = dense.lang),
  sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3),
  pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
      LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
  terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
