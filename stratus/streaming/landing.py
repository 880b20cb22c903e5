"""Payload files as they land -> raw, hourly and current tables.

A file-source stream keeps the ledger of files, so each is read once, by the landing that
finds it first.  A landing parses its documents, keeps what is good, writes what is broken
with reason, text and path to ``rejects``, and merges the rest into tables that hold one
row per (place, time): the newest fetch, also when fetches arrive out of order.

Tables are cut into ranges of a month and a share of the places (``current``: places only).
A merge reads and rewrites the ranges that its rows touch; all others keep their files.  One
commit (:mod:`stratus.streaming.manifest`) lists the files of every range, so a landing is
seen whole or not at all, and one that is run again starts from the same ranges.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.schemas import CURRENT_DEFAULTS, FORECAST_PAYLOAD, HOURLY_FIELDS, RAW_ORDER
from stratus.session import materialize
from stratus.sources import payload
from stratus.streaming import manifest

SHARES = 16
_KEY = [T.StructField("location_id", T.StringType()), T.StructField("fetched_at", T.TimestampType())]
RAW = T.StructType([*_KEY, T.StructField("date", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in RAW_ORDER]])
HOURLY = T.StructType([*_KEY, *[T.StructField(k, t) for k, t in HOURLY_FIELDS], T.StructField("ts", T.TimestampNTZType())])
CURRENT = T.StructType([*_KEY, T.StructField("utc_offset_seconds", T.IntegerType()),
                        *[T.StructField(k, T.DoubleType()) for k in CURRENT_DEFAULTS]])
REJECTS = T.StructType([T.StructField(c, T.StringType()) for c in ("path", "location_id", "reason", "raw")])
TABLES = {"raw": (RAW, ["location_id", "date"]), "hourly": (HOURLY, ["location_id", "ts"]), "current": (CURRENT, ["location_id"])}


def _range(keys: list[str], shares: int) -> Column:
    share = F.pmod(F.xxhash64("location_id"), F.lit(shares)).cast("string")
    return F.concat_ws("-", *[F.date_format(k, "yyyy-MM") for k in keys[1:]], share)


def new_rows(documents: DataFrame) -> dict[str, DataFrame]:
    """Per table the good rows of a landing, one per key."""
    daily = payload.daily_rows(documents).select(RAW.fieldNames())
    return {"raw": payload.newest(daily, ["location_id", "date"]),
            "hourly": payload.hourly_rows(documents).select(HOURLY.fieldNames()),
            "current": payload.current_obs(documents.where("current IS NOT NULL")).select(CURRENT.fieldNames())}


def broken(documents: DataFrame) -> DataFrame:
    """Documents that don't parse, name no place or hold no block, and the broken rows of the others."""
    empty = F.col("daily").isNull() & F.col("hourly").isNull() & F.col("current").isNull()
    whole = payload.bad_records(documents.where(empty))
    held = documents.where(~empty)
    by_block = [payload.bad_records(held.where(F.col(b).isNotNull()), b) for b in ("daily", "hourly")]
    return whole.unionByName(by_block[0]).unionByName(by_block[1]).distinct()


def merge(lines: DataFrame, batch_id: int, root: str, shares: int = SHARES) -> None:
    """Merge documents (``value``, ``path``) into the tables below ``root``."""
    spark = lines.sparkSession
    base = manifest.state(spark, root, before_batch=batch_id)
    documents = materialize(payload.parse_documents(lines, FORECAST_PAYLOAD), "landed-documents")
    folders = dict(base.folders)
    for name, rows in new_rows(documents).items():
        schema, keys = TABLES[name]
        rows = materialize(rows.withColumn("range", _range(keys, shares)), f"landed-{name}")
        # At most a row per month and share.
        touched = {f"range={r.range}" for r in rows.select("range").distinct().collect()}
        if not touched:
            continue
        old = base.folders.get(name, [])
        replaced = [f for f in old if f.split("/")[1] in touched]
        before = spark.read.schema(schema).parquet(*[os.path.join(root, name, f) for f in replaced]) if replaced else spark.createDataFrame([], schema)
        merged = payload.newest(before.unionByName(rows.drop("range")), keys).withColumn("range", _range(keys, shares))
        folder = uuid.uuid4().hex
        (merged.repartition("range").sortWithinPartitions("range", *keys).write.partitionBy("range")
         .parquet(os.path.join(root, name, folder)))
        folders[name] = sorted(set(old) - set(replaced)) + sorted(f"{folder}/{t}" for t in touched)
    folders["rejects"] = [*base.folders.get("rejects", []), manifest.write(broken(documents), root, "rejects")]
    manifest.commit(spark, root, batch_id, folders)
    manifest.vacuum(spark, root)


def run(spark: SparkSession, source: str, root: str, checkpoint: str, multi_line: bool = False,
        max_files_per_trigger: int | None = None, shares: int = SHARES) -> int:
    """Merge the files below ``source`` that no earlier landing read; the number of documents read."""
    manifest.begin(spark, root)
    reader = spark.readStream.option("wholetext", multi_line).option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.text(source).select("value", F.col("_metadata.file_path").alias("path"))
    query = (lines.writeStream.foreachBatch(lambda df, batch_id: merge(df, batch_id, root, shares))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``raw``, ``hourly``, ``current`` or ``rejects`` as of the last landing."""
    schema = REJECTS if name == "rejects" else TABLES[name][0]
    return manifest.read(spark, root, manifest.state(spark, root), name, schema)
