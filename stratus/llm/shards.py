"""Balanced contiguous sharding by global byte-size prefix sums (built-ins only).

Rows are range-partitioned on ``(text_crc32, text hash, id)`` without their
texts, so copies of a text lie next to each other and share a shard unless a
cut falls inside their group.  Per-partition totals give each partition its
global offset, a running sum inside the partition gives each row's, and the
row goes to the shard in which the middle of its byte range falls.  Every
shard's size is therefore within one row of the mean, however the sizes or
copies are distributed.

Defined results: a null text has size ``overhead`` and the crc32 of the empty
text; null ids sort first; repeated rows each get a slot of their own; an empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratus.session import materialize

OVERHEAD_BYTES = 16


def row_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              overhead: int = OVERHEAD_BYTES) -> DataFrame:
    """One small row per document: id, size, checksum and the ordering hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_hash"))


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                  overhead: int = OVERHEAD_BYTES) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs``.

    Shards are contiguous in the order (checksum, text hash, id) and slots are
    gapless from 0 in that order.
    """
    order = ["text_crc32", "_hash", "doc_id"]
    # Written once: the partition number of a row must not change between the
    # totals and the running sums, also when a lost task is run again.
    placed = materialize(
        row_sizes(docs, id_col, text_col, overhead).repartitionByRange(*order)
        .withColumn("_part", F.spark_partition_id()), "shard-sizes")
    # One row per partition: the window over them is bounded by their number.
    totals = placed.groupBy("_part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = materialize(totals.select(
        "_part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_bytes0"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_rows0"),
        F.sum("bytes").over(everything).alias("_total")), "shard-offsets")
    running = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(running), F.lit(0)) + F.col("_bytes0")
    # Offsets have one row per partition of the range exchange.
    located = (placed.join(F.broadcast(offsets), "_part")
               .withColumn("_start", start)
               .withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_rows0"))
               .withColumn("shard", F.expr(f"cast(((2 * _start + size) * {int(shards)}) div (2 * _total) as int)")))
    # Copies with one id and text are equal in the order, so the running sums
    # above could rank them either way after a retry; the outcome is the same.
    firsts = located.groupBy("shard").agg(F.min("_row").alias("_first"))
    return (located.join(F.broadcast(firsts), "shard")      # at most ``shards`` rows
            .select("doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot")))
