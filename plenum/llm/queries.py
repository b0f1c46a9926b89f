"""Queries over the corpus operators: pN_ for problem N, run over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import canonical, encoding_repair, language, leakage, near_duplicates, pii, sentences, tokenize


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.found(_read(spark, folder, "synthetic_theme_benchmark"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.duplicate_groups(_read(spark, folder, "synthetic_theme_benchmark"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.found(_read(spark, folder, "synthetic_theme_benchmark"), _read(spark, folder, "canonical_values"))


def p2_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of p2_found once more, from trees of 100 entries sent in blocks of 400."""
    return canonical.found(_read(spark, folder, "synthetic_theme_benchmark"), _read(spark, folder, "canonical_values"), shard_entries=100, block_entries=400)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.found(_read(spark, folder, "synthetic_theme_benchmark"))


def p3_spans(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_read(spark, folder, "synthetic_theme_benchmark"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.found(_read(spark, folder, "synthetic_theme_benchmark"), _read(spark, folder, "person_redaction_cases"))


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redacted(_read(spark, folder, "synthetic_theme_benchmark"), _read(spark, folder, "person_redaction_cases"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.found(_read(spark, folder, "synthetic_theme_benchmark"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.token_ids(_read(spark, folder, "documents"))


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.decode_ids(tokenize.token_ids(_read(spark, folder, "documents")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.found(_read(spark, folder, "documents"), _read(spark, folder, "eval_items"))


def p7_matches(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(_read(spark, folder, "documents"), _read(spark, folder, "eval_items"))


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of the documents that stay when those with a leak are taken out."""
    documents = _read(spark, folder, "documents")
    return leakage.without_leaks(documents, leakage.leaks(documents, _read(spark, folder, "eval_items"))).select("doc_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding_repair.found(_read(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (p1_found, p1_groups, p2_found, p2_shards, p3_found, p3_spans, p4_found, p4_redacted, p5_found, p6_ids, p6_round_trip, p7_found, p7_matches, p7_clean, p8_found)
    return {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    return {
        # What the decoder must give back: every text, null as empty.
        "p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
