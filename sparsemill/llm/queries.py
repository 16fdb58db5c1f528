"""The queries that apply each corpus operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, license_scan, line_dedup, packing, quality_classifier, quality_rules, simhash, substring_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages found more than once; removed is false for the place where a passage stays."""
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: its lines, how many are dropped, and the digest of the text that stays."""
    out = line_dedup.drop_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("kept_text_lines").alias("n_lines"), F.col("kept_text_dropped").alias("n_dropped"), F.md5(F.col("kept_text").cast("binary")).alias("text_md5"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_classifier.classify(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "quality_score", (F.col("quality_score") >= 0.5).alias("kept"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offending spans as text: start-stop in characters, comma-joined."""
    found = toxicity.tag(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["stop"])), ","))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_substring_dedup, op3_line_dedup, op4_license_scan, op5_quality_classifier, op6_packing, op7_ann, op8_byte_bpe, op9_simhash, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.oracle()}
