"""Evaluation queries over documents and labels."""

from pyspark.sql import functions as F

from quarrylight.operators import evaluation as E
from quarrylight.registry import register
from quarrylight.session import settle, table

TOKEN = 'token = "[0-9a-f]{40}"'
_JOINED = f"""WITH j AS (SELECT d.lang, d.source, (l.quality = 0 OR l.toxic = 1) AS a,
  (d.n_chars < 200 OR regexp_matches(d.text, '{TOKEN}')) AS p FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT BY_COLUMN, count(*) FILTER (a AND p) AS tp, count(*) FILTER (NOT a AND p) AS fp,
  count(*) FILTER (NOT a AND NOT p) AS tn, count(*) FILTER (a AND NOT p) AS fn FROM j GROUP BY 1) """


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


def _counts(spark, sf_dir, by):
    actual = (F.col("quality") == 0) | (F.col("toxic") == 1)
    predicted = (F.col("n_chars") < 200) | F.col("text").rlike(TOKEN)
    return E.confusion(_labelled(spark, sf_dir), actual, predicted, [by])


@register(
    "eval_confusion_by_lang",
    _JOINED.replace("BY_COLUMN", "lang")
    + """, s AS (SELECT *, tp / nullif(tp + fp, 0) AS pr, tp / nullif(tp + fn, 0) AS re, (tp + fn) / nullif(tp + fp + tn + fn, 0) AS b FROM c)
SELECT lang, tp, fp, tn, fn, round(pr, 6) AS precision, round(re, 6) AS recall,
  round(CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / nullif(pr + re, 0) END, 6) AS f1,
  round((tp + tn) / nullif(tp + fp + tn + fn, 0), 6) AS accuracy, round(tn / nullif(tn + fp, 0), 6) AS specificity,
  round((tp + fp) / nullif(tp + fp + tn + fn, 0), 6) AS flag_rate, round(b, 6) AS base_rate, round(2 * b / (b + 1), 6) AS always_flag_f1 FROM s""",
)
def eval_confusion_by_lang(spark, sf_dir):
    return E.scores(_counts(spark, sf_dir, "lang"))


@register(
    "eval_category_rates",
    _JOINED.replace("BY_COLUMN", "source")
    + """, r AS (SELECT *, 100.0::DOUBLE * tp / greatest(tp + fn, 1) AS t, 100.0::DOUBLE * fp / greatest(fp + tn, 1) AS f FROM c)
SELECT source, tp, fp, tn, fn, round(t, 4) AS tpr, round(f, 4) AS fpr, round(t - f, 4) AS score FROM r""",
)
def eval_category_rates(spark, sf_dir):
    return E.category_rates(_counts(spark, sf_dir, "source"))


@register(
    "eval_macro_average",
    _JOINED.replace("BY_COLUMN", "source")
    + """SELECT count(*) AS categories, round(avg(100.0::DOUBLE * tp / greatest(tp + fn, 1) - 100.0::DOUBLE * fp / greatest(fp + tn, 1)), 3) AS macro_score FROM c""",
)
def eval_macro_average(spark, sf_dir):
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    score = 100.0 * tp / F.greatest(tp + fn, F.lit(1)) - 100.0 * fp / F.greatest(fp + tn, F.lit(1))
    return _counts(spark, sf_dir, "source").agg(F.count(F.lit(1)).alias("categories"), F.round(F.avg(score), 3).alias("macro_score"))


@register(
    "eval_skip_accounting",
    """SELECT coalesce(CASE WHEN l.quality IS NULL THEN 'unlabeled' WHEN d.text IS NULL OR trim(d.text) = '' THEN 'empty'
  WHEN strlen(d.text) > 8192 THEN 'oversize' WHEN NOT coalesce(d.lang IN ('en', 'fr'), false) THEN 'unsupported_language' END, 'evaluated') AS reason,
  count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""",
)
def eval_skip_accounting(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    reason = E.skip_reason(F.col("quality"), F.col("text"), F.col("lang"), ["en", "fr"], 8192)
    return rows.groupBy(F.coalesce(reason, F.lit("evaluated")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


#: rules of the probe, by name; a text's rules are those whose pattern it has
RULES = {"token": TOKEN, "email": "[a-z0-9.]+@[a-z0-9.]+", "ipv4": "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "licence": "[Ll]icen[cs]e"}
_RULES_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}' END" for n, p in RULES.items()) + "], lambda x: x IS NOT NULL)"


def rules_of(text):
    return F.array_compact(F.array(*[F.when(F.coalesce(text, F.lit("")).rlike(p), F.lit(n)) for n, p in RULES.items()]))


@register(
    "eval_rule_breakdown",
    f"""WITH r AS (SELECT {_RULES_SQL} AS rules, (l.quality = 0 OR l.toxic = 1) AS a FROM documents d JOIN labels l USING (doc_id)),
e AS (SELECT unnest(rules) AS rule, a FROM r)
SELECT rule, count(*) AS n, count(*) FILTER (a) AS hits, round(count(*) FILTER (a) / count(*), 6) AS share FROM e GROUP BY 1""",
)
def eval_rule_breakdown(spark, sf_dir):
    rows = _labelled(spark, sf_dir).select(rules_of(F.col("text")).alias("rules"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("a"))
    return E.breakdown(rows, "rules", F.col("a"), "rule")


@register(
    "eval_secret_probe",
    f"""WITH r AS (SELECT {_RULES_SQL} AS rules FROM documents)
SELECT count(*) AS texts, count(*) FILTER (len(rules) > 0) AS texts_with_hits, sum(len(rules))::BIGINT AS hits,
  round(1000.0::DOUBLE * sum(len(rules)) / count(*), 4) AS hits_per_1000 FROM r""",
)
def eval_secret_probe(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.size(rules_of(F.col("text"))).alias("n"))
    return rows.agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(F.col("n") > 0).alias("texts_with_hits"), F.sum("n").cast("long").alias("hits"),
        F.round(1000.0 * F.sum("n") / F.count(F.lit(1)), 4).alias("hits_per_1000"),
    )


@register(
    "eval_repair_pairs",
    f"""WITH p AS (SELECT a.lang, {_RULES_SQL.replace('text', 'a.text')} AS b, {_RULES_SQL.replace('text', 'z.text')} AS f
  FROM documents a JOIN documents z ON z.doc_id = a.doc_id + 1),
q AS (SELECT lang, len(b) AS nb, len(f) AS nf, len(list_filter(b, lambda x: NOT list_contains(f, x))) AS gone, len(list_filter(f, lambda x: NOT list_contains(b, x))) AS new FROM p)
SELECT lang, count(*) AS pairs, count(*) FILTER (nb > 0) AS flagged_before, count(*) FILTER (nb > 0 AND nf = 0) AS cleared,
  count(*) FILTER (new > 0) AS introduced, sum(gone)::BIGINT AS rules_cleared, sum(new)::BIGINT AS rules_introduced FROM q GROUP BY 1""",
)
def eval_repair_pairs(spark, sf_dir):
    # the rules run once over the texts; the pairs are joined from what they found
    rows = settle(table(spark, sf_dir, "documents").select("doc_id", "lang", rules_of(F.col("text")).alias("rules")), "rules")
    pairs = rows.alias("a").join(rows.select((F.col("doc_id") - 1).alias("_prev"), F.col("rules").alias("after")), F.col("a.doc_id") == F.col("_prev"))
    return E.repair_pairs(pairs, F.col("rules"), F.col("after"), ["lang"])


@register(
    "stride_sample_documents",
    """WITH n AS (SELECT greatest(1, ceil(count(*) / 300))::BIGINT AS s FROM documents),
r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
SELECT doc_id, lang, i AS place FROM r, n WHERE i % s = 0 ORDER BY i LIMIT 300""",
)
def stride_sample_documents(spark, sf_dir):
    from quarrylight.sources.sampling import stride_sample

    return stride_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], 300)
