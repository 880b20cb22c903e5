"""W1-W4 for series of any length: no window spans a whole series.

Pass 1 ranks: rows are numbered inside a time bucket, and the rows of earlier buckets, a
prefix sum over one small row per (series, bucket), are added.  Positions are gapless and
equal to a row number over the series, so the chronological split needs nothing more.

Pass 2 cuts each series into blocks of ``block_rows`` positions.  The last ``HALO`` rows of
a block are copied to the next one and its first row to the one before, so every lag,
rolling mean and target of a block's own rows is computed inside the block; copies are
dropped.  Results equal :func:`stratus.operators.features.with_features` and
:func:`stratus.operators.split.with_split`; a place that holds most rows is dealt over as
many tasks as it has buckets and blocks.

Defined results: (series, time) is unique, as everywhere (ingest sees to it); rows without
a time come first, in one bucket; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratus.operators.features import with_features
from stratus.schemas import LAGS, ROLL_WINDOWS, TRAIN_FRACTION

BUCKET = "year"
BLOCK_ROWS = 4096
#: Earlier rows that a row's features reach back to.
HALO = max(max(LAGS), max(ROLL_WINDOWS) - 1)


def with_positions(df: DataFrame, key: str = "location_id", order: str = "date", bucket: str = BUCKET) -> DataFrame:
    """``df`` with ``rn`` (1-based position in its series) and ``n`` (the series' rows)."""
    rows = df.withColumn("_bucket", F.date_trunc(bucket, F.coalesce(F.col(order).cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz"))))
    counts = rows.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per bucket: a century of days has a hundred.
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(key).alias("_key"), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
                           F.sum("_rows").over(Window.partitionBy(key)).alias("n"))
    inside = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(order))
    numbered = rows.withColumn("_at", inside)
    same = numbered[key].eqNullSafe(starts["_key"]) & (numbered["_bucket"] == starts["_of"])
    return (numbered.join(starts, same).withColumn("rn", F.col("_at") + F.col("_before"))
            .select(*df.columns, "rn", "n"))


def with_split(df: DataFrame, fraction: float = TRAIN_FRACTION, key: str = "location_id", order: str = "date",
               bucket: str = BUCKET) -> DataFrame:
    """The columns of :func:`stratus.operators.split.with_split`, from positions."""
    out = with_positions(df, key, order, bucket).withColumn("split_at", F.floor(F.lit(float(fraction)) * F.col("n")).cast("long"))
    return out.withColumn("split", F.when(F.col("rn") <= F.col("split_at"), "train").otherwise("test"))


def with_long_features(df: DataFrame, key: str = "location_id", order: str = "date", target: bool = True,
                       bucket: str = BUCKET, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The columns of :func:`stratus.operators.features.with_features`, block by block."""
    if block_rows <= HALO:
        raise ValueError(f"a block must hold more than the {HALO} rows that features reach back to")
    placed = with_positions(df, key, order, bucket).withColumn("_block", F.expr(f"(rn - 1) div {block_rows}"))
    offset = F.expr(f"(rn - 1) % {block_rows}")
    shared = F.array_compact(F.array(F.lit(0), F.when(offset >= block_rows - HALO, F.lit(1)), F.when(offset == 0, F.lit(-1))))
    copies = placed.withColumn("_copy", F.explode(shared)).drop("rn", "n")
    cut = copies.withColumn("_part", F.struct(F.col(key).alias("k"), (F.col("_block") + F.col("_copy")).alias("b")))
    made = with_features(cut.drop("_block"), key="_part", order=order, target=target).where("_copy = 0")
    front = [key, order] + [c for c in df.columns if c not in (key, order)]
    return made.select(*front, *[c for c in made.columns if c not in (*front, "_part", "_copy")])
