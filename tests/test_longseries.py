"""Features and split of long series equal those of whole-series windows, without such a window."""

import pytest
from pyspark.sql import functions as F

from stratus.operators import features, longseries, split
from stratus.session import materialize
from test_edges import series


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def raw(spark):
    lone = series(spark, 1, loc="L")
    return (series(spark, 1200, loc="A").unionByName(series(spark, 130, start="2020-03-01", loc="B", gaps=(40, 41, 90))).unionByName(lone)
            .withColumn("humidity", F.when(F.dayofyear("date") != 77, F.col("humidity"))))


@pytest.mark.parametrize(("bucket", "block_rows"), [("month", 30), ("year", 64), ("day", 4096)])
def test_features_equal_whole_series_windows(raw, bucket, block_rows):
    got = longseries.with_long_features(raw, bucket=bucket, block_rows=block_rows)
    want = features.with_features(raw)
    assert got.columns == want.columns and rows(got) == rows(want)


@pytest.mark.parametrize("bucket", ["day", "month", "year"])
def test_split_equals_whole_series_split(raw, bucket):
    assert rows(longseries.with_split(raw, bucket=bucket)) == rows(split.with_split(raw))


def test_sub_daily_series_and_missing_keys(spark):
    stamps = spark.range(5000).select(F.when(F.col("id") % 2 == 0, "A").alias("location_id"),
                                      F.timestamp_seconds(F.col("id") * 600).cast("timestamp_ntz").alias("date"), F.col("id").alias("v"))
    got = {(r.location_id, r.v): (r.rn, r.n) for r in longseries.with_positions(stamps, bucket="hour").collect()}
    assert got == {("A" if i % 2 == 0 else None, i): (i // 2 + 1, 2500) for i in range(5000)}


def test_one_place_is_dealt_over_many_tasks(spark):
    one = series(spark, 1200, loc="A")
    plan = longseries.with_long_features(one, bucket="month", block_rows=64)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # Only the prefix sum over a series' buckets is per series; rows are dealt by (series, bucket) and (series, block).
    per_series = [w for w in windows if w.rstrip().endswith("[location_id]") or "], [location_id" in w and "_bucket" not in w.split("], [", 1)[1]]
    assert windows and all("sum(_rows" in w for w in per_series)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:        # written whole, so that no window is pruned away
        made = materialize(longseries.with_long_features(one, block_rows=64).withColumn("p", F.spark_partition_id()), "t-long")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert made.select("p").distinct().count() > 1


def test_blocks_must_hold_the_halo(raw):
    with pytest.raises(ValueError, match="must hold"):
        longseries.with_long_features(raw, block_rows=29)
    assert longseries.with_long_features(raw.limit(0)).count() == 0
