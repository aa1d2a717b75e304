"""Dataset catalogs: loading, validation, split resolution, routing and integrity gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "schema_version int, datasets array<struct<id:string, repository:string, revision:string, license:string, purpose:array<string>, "
    "files:array<struct<path:string, size_bytes:bigint, sha256:string>>>>, routes map<string,array<string>>"
)


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def safe_path(path: Column) -> Column:
    return path.isNotNull() & (path != "") & ~path.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")


def files_of(catalog: DataFrame) -> DataFrame:
    d = catalog.select(F.explode("datasets").alias("d"))
    return d.select(F.col("d.id").alias("dataset"), F.explode("d.files").alias("f")).select("dataset", "f.path", "f.size_bytes", "f.sha256")


def catalog_violations(catalog: DataFrame) -> DataFrame:
    """(rule, subject): wrong schema version, repeated ids, unsafe paths, routes to unknown ids."""
    ids = catalog.select(F.explode("datasets.id").alias("subject"))
    routes = catalog.select(F.explode("routes")).select(F.explode("value").alias("subject")).distinct()
    parts = [
        catalog.filter(F.coalesce(F.col("schema_version") != 1, F.lit(True))).select(F.lit("schema_version").alias("rule"), F.col("schema_version").cast("string").alias("subject")),
        ids.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("duplicate_id").alias("rule"), "subject"),
        files_of(catalog).filter(~safe_path(F.col("path"))).select(F.lit("unsafe_path").alias("rule"), F.col("path").alias("subject")),
        routes.join(ids.distinct(), "subject", "left_anti").select(F.lit("unknown_route").alias("rule"), "subject"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def route(catalog: DataFrame, action: str) -> DataFrame:
    """(place, dataset) of an action's datasets, in their order."""
    return catalog.select(F.posexplode(F.coalesce(F.try_element_at("routes", F.lit(action)), F.array())).alias("place", "dataset"))


def split_of(path: Column) -> Column:
    """data/test-0001.parquet: test; small/test-0001.parquet: small/test."""
    name = F.regexp_replace(F.regexp_replace(path, r"-[0-9]+(-of-[0-9]+)?[^/]*$", ""), r"\.[A-Za-z0-9]+$", "")
    return F.regexp_replace(name, "^data/", "")


def files_of_split(files: DataFrame, split: str) -> DataFrame:
    s = split_of(F.col("path"))
    return files.filter((s == split) | (F.element_at(F.split(s, "/"), -1) == split))


def integrity(files: DataFrame, stored: DataFrame) -> DataFrame:
    """files(path, size_bytes, sha256) against stored(path, content): ready, not_installed or integrity_failed."""
    have = stored.select("path", F.octet_length("content").cast("long").alias("_n"), F.sha2("content", 256).alias("_h"))
    state = F.when(F.col("_h").isNull(), "not_installed").when((F.col("_n") != F.col("size_bytes")) | (F.col("_h") != F.lower("sha256")), "integrity_failed").otherwise("ready")
    return files.join(have, "path", "left").select(*files.columns, state.alias("status"))


#: fixed values: names that columns of labelled code go by, in order of preference
COLUMN_NAMES = {
    "code": ["func", "code", "source_code", "source", "snippet", "function", "content", "code_snippet", "vulnerable_code", "text"],
    "label": ["target", "label", "is_vulnerable", "vulnerable", "vul", "is_vuln", "labels", "vulnerability"],
    "cwe": ["cwe", "cwe_id", "cwe_ids", "cwes", "cwe_type", "CWE ID"],
    "language": ["language", "lang", "programming_language"],
}


def resolve_columns(columns: list[str], hints: dict[str, str], required: tuple[str, ...] = ()) -> dict[str, str | None]:
    """Column of each role: the hint if the table has it, else the first known name in any case. Runs where the query is planned.

    Raises ValueError with the table's columns if a required role has none.
    """
    lower = {}
    for c in columns:
        lower.setdefault(c.lower(), c)
    found = {role: hints[role] if hints.get(role) in columns else next((lower[n.lower()] for n in names if n.lower() in lower), None) for role, names in COLUMN_NAMES.items()}
    for role in required:
        if not found[role]:
            raise ValueError(f"could not find a {role} column; available columns: {', '.join(columns)}")
    return found
