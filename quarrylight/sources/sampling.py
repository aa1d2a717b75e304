"""Even-stride samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.session import settle


def stride_sample(df: DataFrame, order: list[str], limit: int, most: int = 200_000) -> DataFrame:
    """Every stride-th row by order with its place, at most limit of them: stride = max(1, ceil(rows / limit)).

    Places are given without one global sort: rows are range-partitioned, each partition is numbered, and partition sizes
    are summed (one row per partition). Dealt rows are settled: range bounds are sampled, so dealing again may deal otherwise.
    """
    limit = min(max(limit, 1), most)
    rows = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "dealt")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    placed = rows.withColumn("_local", local).join(F.broadcast(sizes), "_part").withColumn("place", F.col("_before") + F.col("_local"))
    stride = F.greatest(F.lit(1), F.ceil(F.col("_total") / limit))
    return placed.filter((F.col("place") % stride == 0) & (F.col("place") / stride < limit)).select(*df.columns, "place")


def stride_sample_files(df: DataFrame, file: str, index: str, limit: int, most: int = 200_000) -> DataFrame:
    """Rows whose place in their own file is a multiple of the stride, at most limit of them, files in order of name.

    df has each row's place in its file, from 0 (for Parquet, _metadata.row_index). Of a file's rows kept, one at place p is
    number p / stride, so the budget across files needs the files' sizes and no window over rows.
    """
    limit = min(max(limit, 1), most)
    sizes = df.groupBy(file).agg((F.max(index) + 1).alias("_n"))
    stride = F.greatest(F.lit(1), F.ceil(F.sum("_n").over(Window.partitionBy()) / limit))
    sizes = sizes.withColumn("_stride", stride).withColumn("_kept", F.ceil(F.col("_n") / F.col("_stride")))
    before = F.coalesce(F.sum("_kept").over(Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = df.join(sizes.withColumn("_before", before), file)  # one row a file: broadcast when measured as small
    return placed.filter((F.col(index) % F.col("_stride") == 0) & (F.col("_before") + F.col(index) / F.col("_stride") < limit)).select(*df.columns)
