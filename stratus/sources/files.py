"""File sinks and scans with fixed schemas.

Processed tables are range-partitioned on location_id and sorted by
(location_id, date) instead of one directory per location: at millions of
locations per-key directories would swamp the file listing.  Each file then
covers a narrow location range, so a single-location read skips the other
files and row groups through Parquet min/max statistics, and the write runs
with as many tasks as the shuffle provides (no fixed bucket count capping
the writer parallelism).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.schemas import (DEFAULT_BEST_MODEL, DEFAULT_LAT, DEFAULT_LOCATION, DEFAULT_LON, LAG_COLUMNS,
                             LOCATIONS, RAW_DAILY, RAW_ORDER, ROLL_MEAN_COLUMNS, SEASONAL, TARGET)
from stratus.session import materialize
from stratus.sources.payload import CORRUPT, normalise_raw, typed_rows

# ---------------------------------------------------------------- raw CSV
def write_raw_csv(df: DataFrame, path: str) -> None:
    df.select(RAW_DAILY.fieldNames()).write.mode("overwrite").option("header", True).csv(path)


def checked_raw_csv(spark: SparkSession, path: str, location_id: str | None = None) -> DataFrame:
    """Rows of the raw CSV with ``reason`` (null for good ones), ``row`` (their texts as JSON) and ``path``.

    Every field is read as text and converted row by row: one broken row doesn't stop the scan."""
    fields = [f.name for f in RAW_DAILY.fields if location_id is None or f.name != "location_id"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*fields, CORRUPT)])
    df = (spark.read.schema(schema).option("header", True).option("columnNameOfCorruptRecord", CORRUPT).csv(path)
          .withColumn("fetched_at", F.col("_metadata.file_modification_time")).withColumn("path", F.col("_metadata.file_path")))
    place = F.lit(location_id) if location_id is not None else F.nullif(F.trim("location_id"), F.lit(""))
    df = df.withColumn("location_id", place).withColumnRenamed("date", "time")
    typed = typed_rows(df, "time", F.try_to_date("time", "yyyy-MM-dd"), "date", RAW_ORDER, ["location_id", "fetched_at", "path", CORRUPT])
    whole = F.when(F.col(CORRUPT).isNotNull(), "malformed row").when(F.col("location_id").isNull(), "no location")
    return typed.withColumn("reason", F.coalesce(whole, F.col("reason"))).withColumn("row", F.coalesce(CORRUPT, "row"))


def read_raw_csv(spark: SparkSession, path: str, location_id: str | None = None) -> DataFrame:
    """Typed, normalised scan of the raw CSV.  With ``location_id``, reads the single-place
    layout (``date`` + 7 measures, no location column) and tags its rows.  Of the rows
    of one place and day the most recently written file's wins.  Broken rows are left out
    (:func:`csv_rejects`)."""
    return normalise_raw(checked_raw_csv(spark, path, location_id).where("reason IS NULL"))


def csv_rejects(spark: SparkSession, path: str, location_id: str | None = None) -> DataFrame:
    """The rows that :func:`read_raw_csv` leaves out: ``path, location_id, reason, raw``."""
    return (checked_raw_csv(spark, path, location_id).where("reason IS NOT NULL")
            .select("path", "location_id", "reason", F.col("row").alias("raw")))


def read_raw_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Typed, normalised scan of raw daily Parquet; the newest file's row wins."""
    return normalise_raw(spark.read.schema(RAW_DAILY).parquet(path)
                         .withColumn("fetched_at", F.col("_metadata.file_modification_time")))


# ---------------------------------------------------------------- processed table
def write_processed(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Sorted by place and day.  Written out first: sampling the ranges would run the
    windows a second time.  The range key holds the date, so one place can span files."""
    df = materialize(df, "processed-rows")
    keys = ("location_id", "date")
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions("location_id", "date").write.mode("overwrite").parquet(path)


def read_processed(spark: SparkSession, path: str, location: str | None = None) -> DataFrame:
    df = spark.read.schema(PROCESSED).parquet(path)
    return df if location is None else df.where(F.col("location_id") == location)


# The processed table (S6): raw columns, target, lags, rolling means, seasonal columns.
PROCESSED = T.StructType(
    RAW_DAILY.fields
    + [T.StructField(c, T.DoubleType()) for c in [TARGET] + LAG_COLUMNS + ROLL_MEAN_COLUMNS]
    + [T.StructField(c, T.IntegerType() if c in ("month", "day_of_year") else T.DoubleType()) for c in SEASONAL])

PROCESSED_CSV = T.StructType(
    [T.StructField("date", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in RAW_ORDER + [TARGET] + LAG_COLUMNS + ROLL_MEAN_COLUMNS]
    + [T.StructField(c, T.IntegerType() if c in ("month", "day_of_year") else T.DoubleType()) for c in SEASONAL])


def write_processed_csv(df: DataFrame, path: str) -> None:
    """CSV form of the processed table (42 columns + location_id first)."""
    cols = ["location_id"] + PROCESSED_CSV.fieldNames()
    df.select(cols).write.mode("overwrite").option("header", True).csv(path)


def read_processed_csv(spark: SparkSession, path: str, location_id: str | None = None) -> DataFrame:
    """Typed scan of a processed CSV; with ``location_id``, the single-place
    layout without a location column."""
    fields = ([] if location_id is not None else [T.StructField("location_id", T.StringType())]) \
        + PROCESSED_CSV.fields
    df = (spark.read.schema(T.StructType(fields)).option("header", True).csv(path)
          .withColumn("date", F.to_date(F.substring("date", 1, 10), "yyyy-MM-dd")))
    if location_id is not None:
        df = df.select(F.lit(location_id).alias("location_id"), *PROCESSED_CSV.fieldNames())
    return df


# ---------------------------------------------------------------- forecast export
EXPORT_FIELDS = ["location", "coordinates", "temp_today", "temp_tomorrow", "humidity", "wind_speed",
                 "pressure", "precipitation", "model_used", "biometeorological_alert",
                 "risk_penalty_percentage", "health_guidelines", "timestamp"]

EXPORT_SCHEMA = T.StructType(
    [T.StructField("location_id", T.StringType())]
    + [T.StructField(f, T.DoubleType() if f in ("temp_today", "temp_tomorrow", "humidity", "wind_speed",
                                                "pressure", "precipitation", "risk_penalty_percentage")
                     else T.StringType()) for f in EXPORT_FIELDS])


def write_export(df: DataFrame, path: str) -> None:
    df.select(EXPORT_SCHEMA.fieldNames()).write.mode("overwrite").json(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPORT_SCHEMA).json(path)


# ---------------------------------------------------------------- metrics CSV
METRICS_HEADER = {"model": "Model", "rmse": "Test RMSE (°C)", "mae": "Test MAE (°C)"}


def write_metrics_csv(df: DataFrame, path: str) -> None:
    (df.select("location_id", *[F.col(k).alias(v) for k, v in METRICS_HEADER.items()])
       .write.mode("overwrite").option("header", True).csv(path))


def read_metrics_csv(spark: SparkSession, path: str, location_id: str | None = None) -> DataFrame:
    """Typed scan; with ``location_id``, the single-place layout (Model, RMSE, MAE)."""
    fields = [T.StructField("Model", T.StringType()), T.StructField("Test RMSE (°C)", T.DoubleType()),
              T.StructField("Test MAE (°C)", T.DoubleType())]
    if location_id is None:
        fields = [T.StructField("location_id", T.StringType())] + fields
    df = (spark.read.schema(T.StructType(fields)).option("header", True).option("enforceSchema", False)
          .csv(path).withColumnsRenamed({v: k for k, v in METRICS_HEADER.items()}))
    if location_id is not None:
        df = df.select(F.lit(location_id).alias("location_id"), "model", "rmse", "mae")
    return df


# ---------------------------------------------------------------- registries
def best_model_for(locations: DataFrame, registry: DataFrame | None) -> DataFrame:
    """Registered best model per location, default "Random Forest"."""
    if registry is None:
        return locations.select("location_id", F.lit(DEFAULT_BEST_MODEL).alias("best_model"))
    return (locations.select("location_id")
            .join(registry.select("location_id", F.col("model").alias("_m")), "location_id", "left")
            .select("location_id", F.coalesce("_m", F.lit(DEFAULT_BEST_MODEL)).alias("best_model")))


def parse_coordinates(text: Column) -> tuple[Column, Column]:
    """``"lat,lon"`` -> (lat, lon); both defaults unless it is exactly two numbers."""
    parts = F.split(text, ",")
    pair = F.size(parts) == 2
    lat = F.when(pair, F.trim(F.get(parts, 0)).try_cast("double"))
    lon = F.when(pair, F.trim(F.get(parts, 1)).try_cast("double"))
    both = lat.isNotNull() & lon.isNotNull()
    return F.when(both, lat).otherwise(F.lit(DEFAULT_LAT)), F.when(both, lon).otherwise(F.lit(DEFAULT_LON))


def location_name(text: Column) -> Column:
    """Registered active-location label, default when missing or blank."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(DEFAULT_LOCATION))


def write_locations(df: DataFrame, path: str) -> None:
    """The ``locations`` dimension (one row per place)."""
    df.select(LOCATIONS.fieldNames()).write.mode("overwrite").parquet(path)


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOCATIONS).parquet(path)
