"""Registered queries of the training-data operators, and SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm import decontam, lm, merkle, neardup, oracles, pieces, pii, prefixes, quality, repeats, shards, toolcalls, toxicity, warc


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver was started outside its folder."""
    root = str(Path(__file__).resolve().parents[2])
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


#: Bytes of an Arrow batch: ten thousand rows of long texts, in and out of every task, are a large part of an executor.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Batches of at most ``most`` bytes, unless the session asks for less."""
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_CONF, f"{most + 1}b"))
    if now <= 0 or now > most:
        spark.conf.set(BATCH_CONF, f"{most}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return (toolcalls.link_tool_calls(*toolcalls.calls_of_conversations(turns), toolcalls.SCHEMAS)
            .withColumn("errors", F.array_join("errors", "; "))
            .withColumn("answered_at", F.coalesce("answered_at", F.lit(-1))))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
            .drop("text_hash"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (repeats.repeats_removed(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"), min_count=1)


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (shards.assign_shards(table(spark, sf_dir, "documents"), 40)
            .withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int")))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (warc.archived_pages(table(spark, sf_dir, "pages"), payloads=False)
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    copy = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return (merkle.verified(merkle.document_manifest(table(spark, sf_dir, "documents"), copy))
            .select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"),
                    "folded_root", "verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_personal_data": op1_personal_data,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_tool_calls": op5_tool_calls,
    "op6_decontamination": op6_decontamination,
    "op7_pieces": op7_pieces,
    "op8_repeats": op8_repeats,
    "op9_language_model": op9_language_model,
    "op10_shards": op10_shards,
    "op11_warc": op11_warc,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {
    "op4_near_duplicates": oracles.OP4,
    "op5_tool_calls": oracles.OP5,
    "op6_decontamination": oracles.OP6,
    "op8_repeats": oracles.OP8,
    "op11_warc": oracles.OP11,
    "op12_prefix_trie": oracles.OP12,
    "op13_merkle": oracles.OP13,
}
