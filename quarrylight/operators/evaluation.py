"""Evaluation of labelled data: confusion counts, derived scores, breakdowns, repair pairs and probe rates.

All are conditional sums that combine map-side; a shuffle carries one row per group and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b, null where b is 0."""
    return F.round(a / F.when(b != 0, b), digits)


def confusion(df: DataFrame, actual: Column, predicted: Column, by: list[str]) -> DataFrame:
    cells = {"tp": actual & predicted, "fp": ~actual & predicted, "tn": ~actual & ~predicted, "fn": actual & ~predicted}
    return df.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in cells.items()])


def scores(counts: DataFrame) -> DataFrame:
    """precision, recall, F1, accuracy, specificity, flag and base rate, F1 of flagging everything; null on no denominator."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    precision, recall = tp / F.when(tp + fp > 0, tp + fp), tp / F.when(tp + fn > 0, tp + fn)
    f1 = F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / F.when(precision + recall != 0, precision + recall))
    base = (tp + fn) / F.when(n > 0, n)
    return counts.withColumns(
        {
            "precision": F.round(precision, 6), "recall": F.round(recall, 6), "f1": F.round(f1, 6), "accuracy": ratio(tp + tn, n),
            "specificity": ratio(tn, tn + fp), "flag_rate": ratio(tp + fp, n), "base_rate": F.round(base, 6), "always_flag_f1": F.round(2 * base / (base + 1), 6),
        }
    )


def category_rates(counts: DataFrame) -> DataFrame:
    """TPR, FPR and score (TPR - FPR) in per cent; denominators are at least 1."""
    tpr = 100.0 * F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    fpr = 100.0 * F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1))
    return counts.withColumns({"tpr": F.round(tpr, 4), "fpr": F.round(fpr, 4), "score": F.round(tpr - fpr, 4)})


def breakdown(df: DataFrame, items: str, hit: Column, name: str) -> DataFrame:
    """Per element of an array column: rows that have it, rows that also hit, and their ratio."""
    one = df.select(F.explode(F.array_distinct(items)).alias(name), hit.alias("_hit"))
    return one.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.count_if("_hit").alias("hits")).withColumn("share", ratio(F.col("hits"), F.col("n")))


def repair_pairs(df: DataFrame, before: Column, after: Column, by: list[str]) -> DataFrame:
    """Pairs whose findings were cleared, kept or newly introduced by the fix; before and after are arrays of rules."""
    gone, new = F.size(F.array_except(before, after)), F.size(F.array_except(after, before))
    flagged = F.size(before) > 0
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(flagged).alias("flagged_before"), F.count_if(flagged & (F.size(after) == 0)).alias("cleared"),
        F.count_if(new > 0).alias("introduced"), F.sum(gone).cast("long").alias("rules_cleared"), F.sum(new).cast("long").alias("rules_introduced"),
    )


def skip_reason(label: Column, text: Column, language: Column, languages: list[str], limit: int) -> Column:
    """First reason in a fixed order why a labelled row isn't evaluated; null: evaluated. The limit is in bytes."""
    return (
        F.when(label.isNull(), "unlabeled")
        .when(text.isNull() | (F.trim(text) == ""), "empty")
        .when(F.octet_length(text) > limit, "oversize")
        .when(~F.coalesce(language.isin(languages), F.lit(False)), "unsupported_language")
    )


def cwe_recall(rows: DataFrame) -> DataFrame:
    """rows(vulnerable, labelled array, observed array): per labelled weakness of vulnerable rows, how often anything and how often the same was observed."""
    e = rows.filter("vulnerable").select(F.explode(F.array_distinct("labelled")).alias("cwe"), "observed")
    g = e.groupBy("cwe").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.size("observed") > 0).alias("_any"), F.count_if(F.array_contains("observed", F.col("cwe"))).alias("_same"))
    return g.select("cwe", "samples", ratio(F.col("_any"), F.col("samples")).alias("recall_any"), ratio(F.col("_same"), F.col("samples")).alias("recall_same_cwe"))
