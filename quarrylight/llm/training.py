"""Bounded, deterministic samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def labelled_sample(labels: DataFrame, target: str, folds: int, held_out: int, bound: int) -> DataFrame:
    """At most `bound` rows (doc_id, y) of the training folds: those of the smallest hash of their id.

    Fold held_out is kept apart, every other is for training. Repeated ids count once; null labels are not used.
    """
    rows = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
    rows = rows.groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
