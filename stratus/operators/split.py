"""Chronological 80/20 split per series.

``row_number`` (ordered) and ``count`` (whole partition) share the
partitioning on location_id, so both run after one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratus.operators.features import series_window
from stratus.schemas import TRAIN_FRACTION


def with_split(df: DataFrame, fraction: float = TRAIN_FRACTION, key: str = "location_id",
               order: str = "date") -> DataFrame:
    """Add rn (1-based position), n, split_at = floor(fraction*n), split."""
    w = series_window(key, order)
    whole = Window.partitionBy(key)
    out = df.withColumns({"rn": F.row_number().over(w), "n": F.count(F.lit(1)).over(whole)})
    out = out.withColumn("split_at", F.floor(F.lit(float(fraction)) * F.col("n")).cast("int"))
    return out.withColumn("split", F.when(F.col("rn") <= F.col("split_at"), "train").otherwise("test"))


def split_summary(split_df: DataFrame) -> DataFrame:
    """Size and date bounds of each side of the split."""
    return (split_df.groupBy("location_id", "split")
            .agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"),
                 F.max("date").alias("last_date")))
