"""Gapless positions within groups of any size, without a window over a whole group.

Rows are range-partitioned by (group, order, tie) and written with their partition and
place in it (``monotonically_increasing_id`` over sorted partitions).  A position is that
place, less where the group starts in the partition, plus the group's rows in earlier
partitions: a running sum over one row per (group, partition).  A group that holds all
rows is spread over all partitions and no task holds more than its range.

Defined results: null groups are a group of their own and null order values come first;
rows equal in group and order get different positions, in either order; an empty table
gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratus.session import materialize


def null_safe(left: DataFrame, right: DataFrame, columns: list[str]):
    """Join condition: equal in all ``columns``, nulls equal to nulls."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def join_null_safe(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Inner join on ``columns``, nulls equal to nulls; columns of ``left``, then the others of ``right``."""
    other = right.select(*[F.col(c).alias(f"_key_{i}") for i, c in enumerate(columns)],
                         *[c for c in right.columns if c not in columns])
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(other[f"_key_{i}"]) for i, c in enumerate(columns)])
    return left.join(other, same).drop(*[f"_key_{i}" for i in range(len(columns))])


def with_positions(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``slot`` (from 0 within the group, by ``order``) and ``group_rows``."""
    keys = [*group, *order, "_tie"]
    # Both are written: ties and places must not change when a lost task is run again.
    tied = materialize(rows.withColumn("_tie", F.monotonically_increasing_id()), f"{name}-rows")
    placed = materialize(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
                         .withColumn("_at", F.monotonically_increasing_id()), f"{name}-placed")
    # The upper bits of the id are the partition, and partitions follow the ranges.
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # A group has at most one row per partition here.
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(*group, "_part", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
                         F.sum("_rows").over(Window.partitionBy(*group)).alias("group_rows"))
    return (join_null_safe(placed, starts, [*group, "_part"])
            .withColumn("slot", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before"))
