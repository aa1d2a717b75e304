"""Structured Streaming over event tables: windowed rates, deduplication and incremental lifecycle merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.operators.lifecycle import merge_findings
from quarrylight.session import scratch

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_rates(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def first_seen_only(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def maintain_findings(events: DataFrame, keys: list[str], checkpoint: str | None = None) -> tuple[Callable[[], str | None], object]:
    """Start a query that merges every micro-batch's keys into a findings snapshot; (path of the latest snapshot, query).

    Snapshots live beside the checkpoint, named by batch. A batch starts from the newest snapshot before its own, so after a
    restart from the checkpoint nothing is lost, and a batch that runs again writes the same one. Coverage is never complete
    in a stream, so nothing is resolved.
    """
    spark = events.sparkSession
    checkpoint = checkpoint or scratch(spark, "stream")
    base = f"{checkpoint.rstrip('/')}-findings"

    def snapshots() -> list[int]:
        """Numbers of the snapshots, from the folder's listing. One before the running batch is whole: its batch was committed."""
        try:
            files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{base}/*/")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return sorted(r["n"] for r in files.select(F.regexp_extract("path", "/([0-9]{8})/[^/]*$", 1).cast("int").alias("n")).distinct().collect())

    def merge(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        seen = batch.groupBy(*keys).agg(F.max("ts").alias("_at"))
        empty = T.StructType([*[T.StructField(k, batch.schema[k].dataType) for k in keys], *T.StructType.fromDDL("status string, first_seen timestamp, last_seen timestamp")])
        before = [n for n in snapshots() if n < number]
        old = s.read.parquet(f"{base}/{before[-1]:08d}") if before else s.createDataFrame([], empty)
        now = seen.agg(F.max("_at")).first()[0]
        merge_findings(old, seen, keys, F.lit(now).cast("timestamp"), False).drop("change").write.mode("overwrite").parquet(f"{base}/{number:08d}")

    query = events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return (lambda: f"{base}/{snapshots()[-1]:08d}" if snapshots() else None), query
