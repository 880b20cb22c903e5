"""disaggregate a daily row into 24 hourly rows (diurnal sine)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIURNAL_DIGITS = 9  # cross-engine stable display temperature


def hourly_from_daily(df: DataFrame) -> DataFrame:
    """One input row -> 24 rows: mean + sin((h-6)*pi/12) * (max-min)/2.

    Row-local: ``explode(sequence(0, 23))`` needs no shuffle, so it scales
    with the input and keeps partitioning.
    """
    h = F.col("hour")
    temp = F.col("temp_mean") + F.sin((h - 6) * F.pi() / 12.0) * ((F.col("temp_max") - F.col("temp_min")) / 2.0)
    return (df.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
            .select(
                "location_id",
                F.timestamp_add("HOUR", h, F.col("date").cast("timestamp_ntz")).alias("ts"),
                F.round(temp, DIURNAL_DIGITS).alias("temperature_2m"),
                F.col("humidity").alias("relative_humidity_2m"),
                F.when(F.col("precipitation") > 0, 20).otherwise(0).alias("precipitation_probability"),
                F.col("wind_speed").alias("wind_speed_10m"),
                F.col("pressure").alias("pressure_msl"),
                F.lit(0).alias("weather_code")))
