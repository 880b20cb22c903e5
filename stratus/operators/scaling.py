"""A5, M4, M5: per-location min-max scaling fitted on training rows only.

Spark's MinMaxScaler fits one range for the whole column and maps a constant
column to 0.5; the training code scales each series on its own and a zero
range keeps span 1.  Two forms:

* :func:`with_minmax` (used in the pipelines) fits and applies in one pass
  with train-only min/max window aggregates over location_id -- the
  partitioning the split's window already produced, so no exchange, no join
  and no second scan of the upstream;
* :func:`fit_minmax` + :func:`apply_minmax` produce and use a persisted stats
  table (one row per location), needed to scale live sequences (M9).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratus.schemas import SEQUENCE_FEATURES, TARGET


def fit_minmax(split_df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A5: min and max of each column over training rows, per location."""
    cols = cols or SEQUENCE_FEATURES + [TARGET]
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return split_df.where(F.col("split") == "train").groupBy("location_id").agg(*aggs)


def span(lo: Column, hi: Column) -> Column:
    return F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))


def scale(x: Column, lo: Column, hi: Column) -> Column:
    """M4: (x - min) / span; a constant training column maps to x - min."""
    return (x - lo) / span(lo, hi)


def unscale(p: Column, lo: Column, hi: Column) -> Column:
    """M5: inverse of :func:`scale`."""
    return p * span(lo, hi) + lo


def apply_minmax(df: DataFrame, stats: DataFrame, cols: list[str] | None = None,
                 suffix: str = "_s") -> DataFrame:
    """M4: add ``{c}{suffix}`` scaled columns using the location's stats."""
    cols = cols or SEQUENCE_FEATURES + [TARGET]
    joined = df.join(stats, "location_id")
    scaled = {f"{c}{suffix}": scale(F.col(c), F.col(f"{c}_min"), F.col(f"{c}_max")) for c in cols}
    keep_stats = [f"{TARGET}_min", f"{TARGET}_max"]
    drop = [f"{c}_{m}" for c in cols for m in ("min", "max") if f"{c}_{m}" not in keep_stats]
    return joined.withColumns(scaled).drop(*drop)


def with_minmax(split_df: DataFrame, cols: list[str] | None = None, suffix: str = "_s") -> DataFrame:
    """A5 + M4 in one pass: train-only min/max as whole-partition window
    aggregates on location_id (the partitioning the split already has), so
    there is no second scan of the upstream and no join.  Locations without
    training rows are dropped, as the join-based :func:`apply_minmax` does.
    """
    from pyspark.sql import Window
    cols = cols or SEQUENCE_FEATURES + [TARGET]
    whole = Window.partitionBy("location_id")
    train = F.col("split") == "train"
    stats = {}
    for c in cols:
        stats[f"{c}_min"] = F.min(F.when(train, F.col(c))).over(whole)
        stats[f"{c}_max"] = F.max(F.when(train, F.col(c))).over(whole)
    fitted = split_df.withColumns(stats).where(F.col(f"{cols[0]}_min").isNotNull())
    scaled = {f"{c}{suffix}": scale(F.col(c), F.col(f"{c}_min"), F.col(f"{c}_max")) for c in cols}
    keep_stats = {f"{TARGET}_min", f"{TARGET}_max"}
    return fitted.withColumns(scaled).drop(*[k for k in stats if k not in keep_stats])
