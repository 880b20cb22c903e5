"""Corpus pipeline: toxicity, near duplicates, decontamination, personal data, pieces.

Every stage takes all rows that the stage before it kept, as a Parquet table, and
returns those it keeps with the columns of ``documents`` (the last: pieces).  No
stage samples, caps or cuts texts.  Two stages learn a model, so SQL cannot express
the rows; tests check each stage's rows and columns, and the operators' own tests
hold brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm import decontam, neardup, pieces, pii, toxicity
from stratus.llm.queries import bound_batches, importable, table
from stratus.session import materialize

#: Bytes of an Arrow batch.  Executors and their Python workers outlive a stage: what one stage's batches took stays with the next.
STAGE_BATCH_BYTES = 2 << 20


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score 0.5 or more."""
    bound_batches(spark, STAGE_BATCH_BYTES)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group (five-word shingles, similarity 0.8)."""
    importable(spark)
    bound_batches(spark, STAGE_BATCH_BYTES)
    return neardup.drop_near_duplicates(docs, shingle=5, percent=80)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents with a twentieth of their words in benchmark windows."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def stage_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind and recounts the characters."""
    redacted = pii.redact(docs)
    if "n_chars" not in redacted.columns:
        return redacted
    return redacted.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast("long"))


def stage_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    importable(spark)
    bound_batches(spark, STAGE_BATCH_BYTES)
    return pieces.encode_pieces(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("near_duplicates", stage_near_duplicates),
    ("decontamination", stage_decontamination),
    ("personal_data", stage_personal_data),
    ("pieces", stage_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
