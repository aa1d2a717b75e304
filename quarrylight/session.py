"""Session helpers: builder, table readers and materialisation in shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarrylight")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns of df; one that it lacks is null, as a string."""
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


def workers_find_us(spark: SparkSession) -> None:
    """Put this checkout on the Python workers' path (a no-op where it is installed there)."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own for the application, which only a local session can share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quarrylight-"))


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarrylight/{uuid.uuid4().hex}/{name}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder, through the file system that holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame, name: str = "t", instead_of: DataFrame | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    instead_of: a settled table that nothing will read again; its folder goes when df is written.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    if instead_of is not None:
        release(instead_of)
    return out


#: rows of a settled table that a join may broadcast
FEW = 1 << 17


def beside(t: DataFrame) -> DataFrame:
    """A settled table as a side of a join: broadcast if it has few rows, else dealt by key and hashed where it lies.

    Left to itself, the optimizer goes by the size of the files, and rows of few different values take up to a hundred times
    that in the driver.
    """
    return F.broadcast(t) if t.count() <= FEW else t.hint("shuffle_hash")


def release(*tables: DataFrame) -> None:
    """Drop the folders of settled tables that nothing will read again."""
    for t in tables:
        discard(t.sparkSession, t._settled_at)
