"""A corpus pipeline of five stages; each works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import neardup, packing, privacy, quality, suffixdup
from tallyloom.llm.tables import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a string that is cut where it repeats: 51 words hold as many even if they have three letters on average.
REPEATED = 200


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality rules keep; null and short texts go."""
    return quality.judged(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group (5-word shingles): that with the smallest doc_id, then hash of its text."""
    return neardup.one_of_each(docs.select(*COLUMNS), k=5)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the bytes of strings found twice or more from the texts; n_chars follows, and texts of which nothing is left go."""
    cut = suffixdup.without_repeats(docs.select(*COLUMNS), length=REPEATED).where("n_removed = 0 OR length(kept_text) > 0")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def privacy_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data and the terms beside it that disclose it; n_chars follows."""
    old = docs.select(*COLUMNS, F.col("text").alias("old_text"))
    new = privacy.sanitised(old)
    return new.select("doc_id", "text", "lang", "source", F.when(F.col("text").eqNullSafe(F.col("old_text")), F.col("n_chars")).otherwise(F.length("text").cast("long")).alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all texts into sequences of 4096 tokens."""
    return packing.packed(docs, packing.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("privacy", privacy_masks),
    ("best_fit_packing", best_fit_packing),
]

#: The grouping, cutting and packing stages are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
