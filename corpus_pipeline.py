"""The corpus pipeline: STAGES in order, each over all that its predecessor kept.

Every stage but the last returns the columns of its documents. Stages that change
texts set n_chars to the new length and leave out documents that lost all words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsemill.llm import line_dedup, near_copies, packing, quality_classifier, substring_dedup
from sparsemill.llm.common import fresh, stored

#: No SQL: the stages learn a model, hash bytes and search for a packing. Tests hold them against brute force.
ORACLE_SQL = None

#: Ids from here on stand for the texts of documents without an id.
NO_ID = 1 << 62


def _words(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"[^\x09-\x0D\x20]")


def _rewritten(docs: DataFrame, columns: list[str], new: str) -> DataFrame:
    """docs with the new text in place of the old one, without documents that lost all words."""
    changed = ~F.col(new).eqNullSafe(F.col("text"))
    out = docs.where(~changed | _words(F.col(new)) | ~_words(F.col("text")))
    n_chars = F.when(changed, F.char_length(new).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in columns else None
    return out.select(*[F.col(new).alias(c) if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the weak-label classifier (5) takes for good."""
    (score,) = fresh(docs, "score")
    return quality_classifier.classify(docs, score_col=score).where(F.col(score) >= 0.5).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of recurring templates (3)."""
    (new,) = fresh(docs, "new")
    return _rewritten(line_dedup.drop_lines(docs, out_col=new), docs.columns, new)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near copies, linked from a Jaccard similarity of 0.8 of their five-word shingles on (9: by SimHash fingerprints, verified by whole shingle sets); unlike texts of one id stay. Of rows of an id and a text, the one whose columns hash lowest."""
    name, own, row = fresh(docs, "key", "own", "row")
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.withColumns({name: F.coalesce("doc_id", F.lit(NO_ID) + F.pmod(text, F.lit(NO_ID))), own: text, row: F.xxhash64(*docs.columns)})
    kept = near_copies.near_copies(keyed, id_col=name).where("doc_id = component_id and text_key = component_key")
    kept = kept.select(F.col("doc_id").alias(name), F.col("text_key").alias(own)).distinct()
    lowest = keyed.select(name, own, row).join(kept, [name, own]).groupBy(name, own).agg(F.min(row).alias(row))
    return keyed.join(stored(lowest, "kept"), [name, own, row], "left_semi").dropDuplicates([name, own, row]).select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages that stand in an earlier document or place (2)."""
    (new,) = fresh(docs, "new")
    return _rewritten(substring_dedup.deduplicate(docs, out_col=new), docs.columns, new)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs tokens into sequences (6): a row for each piece of a document."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_dedup", near_dedup), ("substrings", substrings), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
