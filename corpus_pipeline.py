"""The corpus pipeline: quality rules, near-dedup, substring dedup, decontamination and SentencePiece encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's result as Parquet in the shared folder and reads it back as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.decontaminate import decontaminate
from quarrylight.llm.minhash import near_duplicates
from quarrylight.llm.quality_rules import quality_rules
from quarrylight.llm.sentencepiece_lattice import encode_documents
from quarrylight.llm.substrings import dedup_substrings
from quarrylight.session import settle, table, workers_find_us


#: ids of documents that have none start here: one for each text, behind all others
UNNAMED = 1 << 62


def _identified(docs: DataFrame) -> DataFrame:
    """(_id, _row): an id for every row, and the row itself as one struct, so no name of docs can clash with an operator's.

    A row without doc_id gets an id made of its text, behind all real ones. So it is judged like any other, equal texts
    without an id are one document, and a copy that has an id goes before one that has none.
    """
    unnamed = F.lit(UNNAMED) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(UNNAMED - 1))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), unnamed).alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def _fields(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select(F.col("_id").alias("doc_id"), *[F.col("_row")[n].alias(n) for n in names])


def _without(rows: DataFrame, going: DataFrame, name: str) -> DataFrame:
    """Rows whose id is not among going(doc_id), with their own columns."""
    return rows.join(settle(going.select(F.col("doc_id").alias("_id")).distinct(), name), "_id", "left_anti").select("_row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or lie outside their source's robust ellipsoid, go.

    Null or empty texts fail (under ten words). Null lang or source: a group of its own. Rows without doc_id are judged by
    their text. Rows of one doc_id go together if one of them is rejected. An empty table stays empty. Any further columns stay.
    """
    rows = _identified(docs)
    return _without(rows, quality_rules(_fields(rows, "text", "lang", "source")).filter(~F.col("kept")), "rejected")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays.

    Null or empty texts are linked with nothing and stay. Rows without doc_id come behind all others; rows of one doc_id stay
    or go together. Ties can't occur: ids differ. An empty table stays empty. Any further columns stay.
    """
    workers_find_us(spark)
    rows = _identified(docs)
    return _without(rows, near_duplicates(_fields(rows, "text"), 5, 80).filter(~F.col("kept")), "dropped")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a 50-word window of a document with a smaller id are cut out of the text; n_chars is counted again.

    Null texts become empty. Rows without doc_id come behind all others; rows of one doc_id are one document. An empty table
    stays empty. Any further columns stay as they are, whatever their names.
    """
    workers_find_us(spark)
    rows = _identified(docs).select(F.col("_id").alias("doc_id"), F.col("_row.text").alias("text"), "_row")
    cut = dedup_substrings(rows, 50, text_out=True, keep=["_row"])
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*[new.get(c, F.col("carried")["_row"][c]).alias(c) for c in docs.columns])


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also a re-parameterised one, go.

    Null or empty texts hold none. Rows without doc_id are judged by their text; rows of one doc_id go together if one of
    them holds an item. Repeated items change nothing; an empty benchmark removes nothing. Any further columns stay.
    """
    workers_find_us(spark)
    rows = _identified(docs)
    return _without(rows, decontaminate(_fields(rows, "text"), table(spark, sf_dir, "benchmark")).filter("contaminated"), "leaked")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left, a row per row: doc_id, n_pieces, ids, round_trip. Null or empty text: no pieces. Null ids stay null."""
    workers_find_us(spark)
    return encode_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("sentencepiece", encode_stage),
]
#: SQL cannot express robust estimates or piece merges; tests hold each stage against its brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
