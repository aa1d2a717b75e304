"""Runtime Bloom filters for joins of all texts with a part of their ids."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: settings of the optimizer's own Bloom filter rule; a filter has at most 8 MB (its default bound)
SETTINGS = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0b",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
}


@contextmanager
def runtime_filters(spark: SparkSession) -> Iterator[None]:
    """Queries run inside drop rows before a shuffle join whose other side, a filtered scan, lacks their key."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
