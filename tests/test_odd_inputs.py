"""Queries over small tables whose rows are unlike the given ones, against their SQL."""

import duckdb

from quarrylight import registry
from tests.oracle import compare


def _agrees(spark, tmp_path, name, tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    return compare(registry.QUERIES[name](spark, str(tmp_path)), con, registry.ORACLES[name])


def test_texts_that_hold_secrets_of_their_own(spark, tmp_path):
    texts = ["a password=x", "token: 1", None, "eyJh.eyJz.sig", "Bearer x", "sk-1", "bearbearer er x"]
    rows = [(6 * i + k, t) for i, t in enumerate(texts) for k in (0, 4)]
    assert _agrees(spark, tmp_path, "sensitive_texts", {"documents": (rows, "doc_id long, text string")}) is None
