"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm.chat import ORACLE as CHAT_ORACLE
from quarrylight.llm.divergence import ORACLE as DIVERGENCE_ORACLE
from quarrylight.session import table, workers_find_us


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.warc import archive_pages

    workers_find_us(spark)
    return archive_pages(table(spark, sf_dir, "pages"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.quality_model import score_quality

    workers_find_us(spark)
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.sentencepiece_lattice import encode_documents

    workers_find_us(spark)
    return encode_documents(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.substrings import dedup_substrings

    workers_find_us(spark)
    return dedup_substrings(table(spark, sf_dir, "documents"), 50)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.licences import scan_licences

    workers_find_us(spark)
    return scan_licences(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.decontaminate import decontaminate

    workers_find_us(spark)
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.toxicity import score_toxicity

    workers_find_us(spark)
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.minhash import near_duplicates

    workers_find_us(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.vector_codes import compress_vectors

    workers_find_us(spark)
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.llm.simhash import simhash_groups

    workers_find_us(spark)
    return simhash_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_chat_format": op2_chat_format,
    "op3_quality_model": op3_quality_model,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontaminate": op7_decontaminate,
    "op8_toxicity": op8_toxicity,
    "op10_minhash": op10_minhash,
    "op9_licence_scan": op9_licence_scan,
    "op11_source_divergence": op11_source_divergence,
    "op12_vector_codes": op12_vector_codes,
    "op13_simhash": op13_simhash,
}
ORACLES: dict[str, str] = {"op2_chat_format": CHAT_ORACLE, "op11_source_divergence": DIVERGENCE_ORACLE}
