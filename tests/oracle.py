"""Runs queries in Spark and their SQL in DuckDB and compares schemas and values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(_value, v)) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if hasattr(v, "as_integer_ratio"):
        return _value(float(v))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql) -> str | None:
    """None where both agree, else what differs."""
    got_cols = spark_df.columns
    res = con.execute(sql)
    want_cols = [d[0] for d in res.description]
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    got, want = rows_of(got_cols, [tuple(r) for r in spark_df.collect()]), rows_of(want_cols, res.fetchall())
    if got != want:
        here, there = set(got), set(want)
        extra, missing = list(here - there)[:3], list(there - here)[:3]
        return f"{len(got)} rows, expected {len(want)}; only here {extra}; only there {missing}"
    return None
