"""Landed provider payloads <-> typed rows.

Payloads are JSON documents holding parallel arrays (one array per field).
They are read with a fixed schema (never inferred) and transposed with
``inline(arrays_zip(...))``, a row-local generator: no shuffle, and the work
is split by input file.  Ragged arrays are padded with null by arrays_zip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.schemas import (ARCHIVE_PAYLOAD, CURRENT_DEFAULTS, FALLBACK_MIN_ROWS, FALLBACK_ROWS,
                             FORECAST_PAYLOAD, HOURLY_FIELDS, RAW_ORDER, RENAME)

PROVIDER = {v: k for k, v in RENAME.items()}   # canonical -> provider name


CORRUPT = "corrupt"


def _as_text(schema: T.StructType) -> T.StructType:
    """The payload schema with every array as texts, so that one broken value breaks its row only."""
    def loose(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(T.StringType())
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(f.name, loose(f.dataType)) for f in kind.fields])
        return kind
    return T.StructType([*loose(schema).fields, T.StructField(CORRUPT, T.StringType())])


def read_documents(spark: SparkSession, paths: str | list[str], schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """One row per document: the payload's fields, its text (``raw``), its file (``path``) and,
    if it doesn't parse, ``corrupt``.  Blank lines are no documents."""
    lines = spark.read.option("wholetext", multi_line).text(paths)
    return parse_documents(lines.select("value", F.col("_metadata.file_path").alias("path")), schema)


def parse_documents(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """``value`` (a document's text) and ``path`` -> the rows of :func:`read_documents`."""
    parsed = F.from_json("value", _as_text(schema), {"columnNameOfCorruptRecord": CORRUPT})
    return (lines.where(F.trim("value") != "").select(parsed.alias("_d"), F.col("value").alias("raw"), "path")
            .select("_d.*", "raw", "path"))


def read_archive(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON lines by default; ``multi_line`` for one provider document per file."""
    return read_documents(spark, path, ARCHIVE_PAYLOAD, multi_line)


def read_forecast(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_documents(spark, path, FORECAST_PAYLOAD, multi_line)


def _document_fault(payloads: DataFrame, block: str | None) -> Column:
    """Why a whole document (or its block) can't be used; null if it can."""
    named = F.nullif(F.trim("location_id"), F.lit("")).isNotNull()
    fault = F.when(~named & F.col(CORRUPT).isNotNull(), "malformed document") if CORRUPT in payloads.columns else F.when(F.lit(False), "")
    fault = fault.when(~named, "no location")
    return fault.when(F.col(block).isNull(), f"no {block} block") if block else fault


def rejects(payloads: DataFrame, block: str = "daily") -> DataFrame:
    """Documents that give no row: malformed, without a place, or without the block."""
    return (payloads.withColumn("reason", _document_fault(payloads, block)).where("reason IS NOT NULL")
            .select("location_id", "fetched_at", "reason"))


def bad_records(payloads: DataFrame, block: str = "daily") -> DataFrame:
    """Every document and every row of a block that was left out: ``path, location_id, reason, raw``."""
    documents = (payloads.withColumn("reason", _document_fault(payloads, block)).where("reason IS NOT NULL")
                 .select("path", "location_id", "reason", "raw"))
    rows = _checked_daily(payloads) if block == "daily" else _checked_hourly(payloads)
    return documents.unionByName(rows.where("reason IS NOT NULL").select("path", "location_id", "reason", F.col("row").alias("raw")))


def _null_nan(c: Column) -> Column:
    # Q4: NaN is "missing"; Spark compares NaN as larger than every number.
    return F.nanvl(c, F.lit(None).cast("double"))


def _zip_block(payloads: DataFrame, block: str, fields: list[str]) -> Column:
    """arrays_zip of a block's fields.  A missing field becomes an empty array
    (then null-padded): arrays_zip would return null -- losing every row of
    the payload -- if any one input array were null."""
    types = {f.name: f.dataType for f in payloads.schema[block].dataType.fields}
    return F.arrays_zip(*[F.coalesce(F.col(f"{block}.{f}"), F.array().cast(types[f])).alias(f)
                          for f in fields])


def _number(c: Column) -> Column:
    # A document's NaN arrives as a quoted word.
    return F.trim(c.cast("string"), F.lit('"')).try_cast("double")


def typed_rows(rows: DataFrame, when: str, parsed: Column, kind: str, numbers: list[str], kept: list[str]) -> DataFrame:
    """Rows of texts -> typed rows with ``reason`` (null for good ones) and ``row``, the texts as JSON.

    A row without a readable time, or with a value that should be a number and is none, is
    left with its reason; nulls and NaN are no faults."""
    bad = [F.when(F.col(c).isNotNull() & _number(F.col(c)).isNull(), F.lit(c)) for c in numbers]
    listed = F.concat_ws(", ", *bad)
    reason = (F.when(F.col(when).isNull(), f"no {kind}").when(parsed.isNull(), f"bad {kind}")
              .when(listed != "", F.concat(F.lit("bad number: "), listed)))
    return rows.select(*kept, reason.alias("reason"), F.to_json(F.struct(when, *numbers)).alias("row"), parsed.alias(kind),
                       *[_null_nan(_number(F.col(c))).alias(c) for c in numbers])


def _kept(payloads: DataFrame, names: list[str]) -> list[str]:
    return [c for c in (*names, "path") if c in payloads.columns]


def _checked_daily(payloads: DataFrame, with_code: bool = False) -> DataFrame:
    fields = list(RENAME) + (["weather_code"] if with_code else [])
    kept = _kept(payloads, ["location_id", "fetched_at"])
    if with_code:      # whether the feed has codes at all; a null inside a present array is a code of its own
        payloads = payloads.withColumn("has_codes", F.col("daily.weather_code").isNotNull())
        kept.append("has_codes")
    rows = (payloads.where(_document_fault(payloads, "daily").isNull())
            .select(*kept, F.inline(_zip_block(payloads, "daily", fields))).withColumnsRenamed({k: v for k, v in RENAME.items() if k != "time"}))
    numbers = RAW_ORDER + (["weather_code"] if with_code else [])
    typed = typed_rows(rows, "time", F.try_to_date("time"), "date", numbers, kept)
    return typed.withColumn("weather_code", F.col("weather_code").cast("int")) if with_code else typed


def daily_rows(payloads: DataFrame, with_code: bool = False) -> DataFrame:
    """S1 + S3: one typed row per (payload, day) with canonical names; broken rows are in :func:`bad_records`."""
    return _checked_daily(payloads, with_code).where("reason IS NULL").drop("reason", "row", "path")


def dedupe_daily(rows: DataFrame) -> DataFrame:
    """Q16: one row per (location_id, date); the newest ``fetched_at`` wins.

    A hash aggregate with ``max_by`` combines map-side, so a group of copies
    holding a third of all rows is reduced before the shuffle.
    """
    value_cols = [c for c in rows.columns if c not in ("location_id", "date", "fetched_at")]
    # A copy without fetch time ranks oldest (max_by skips null orderings); of
    # copies fetched at once the greatest row wins, so retries agree.
    fetched = F.coalesce(F.col("fetched_at"), F.lit(0).cast("timestamp"))
    newest = F.max_by(F.struct(*value_cols), F.struct(fetched, *value_cols))
    return (rows.groupBy("location_id", "date").agg(newest.alias("v"))
            .select("location_id", "date", *[F.col(f"v.{c}").alias(c) for c in value_cols]))


def normalise_raw(rows: DataFrame) -> DataFrame:
    """The one ingest rule of CSV, Parquet and JSON rows (Q4, Q16): NaN is null, one
    row per (location_id, date), the newest ``fetched_at`` wins."""
    measures = {c: _null_nan(F.col(c)) for c in RAW_ORDER}
    return dedupe_daily(rows.withColumns(measures).select("location_id", "date", "fetched_at", *RAW_ORDER)).select(
        "location_id", "date", *RAW_ORDER)


def ingest_archive(payloads: DataFrame) -> DataFrame:
    """Archive payloads -> deduplicated raw daily table."""
    return normalise_raw(daily_rows(payloads))


def _checked_hourly(payloads: DataFrame) -> DataFrame:
    fields = ["time"] + [k for k, _ in HOURLY_FIELDS]
    kept = _kept(payloads, ["location_id", "fetched_at"])
    rows = payloads.where(_document_fault(payloads, "hourly").isNull()).select(*kept, F.inline(_zip_block(payloads, "hourly", fields)))
    parsed = F.try_to_timestamp("time", F.lit("yyyy-MM-dd'T'HH:mm")).cast("timestamp_ntz")
    typed = typed_rows(rows, "time", parsed, "ts", fields[1:], kept)
    return typed.withColumns({f: F.col(f).cast("int") for f, kind in HOURLY_FIELDS if kind == T.IntegerType()})


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the newest ``fetched_at``, of those fetched at once the greatest.

    A hash aggregate that combines map-side; a row without fetch time ranks oldest."""
    values = [c for c in rows.columns if c not in keys]
    fetched = F.coalesce(F.col("fetched_at"), F.lit(0).cast("timestamp"))
    pick = F.max_by(F.struct(*values), F.struct(fetched, *[c for c in values if c != "fetched_at"]))
    return rows.groupBy(*keys).agg(pick.alias("_v")).select(*[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in rows.columns])


def hourly_rows(payloads: DataFrame) -> DataFrame:
    """Hourly block -> one row per place and hour, the newest fetch's; ``ts`` is
    location-local wall-clock time (TIMESTAMP_NTZ)."""
    rows = _checked_hourly(payloads).where("reason IS NULL").drop("reason", "row", "path")
    return newest(rows.select("location_id", "fetched_at", *[k for k, _ in HOURLY_FIELDS], "ts"), ["location_id", "ts"])


def current_obs(payloads: DataFrame) -> DataFrame:
    """The newest fetch's current observation per place, with per-field defaults (missing or null)."""
    cols = [F.coalesce(_null_nan(F.col(f"current.{k}")), F.lit(v)).alias(k) for k, v in CURRENT_DEFAULTS.items()]
    usable = payloads.where(_document_fault(payloads, None).isNull())
    return newest(usable.select("location_id", "fetched_at", "utc_offset_seconds", *cols), ["location_id"])


def _field(name: str):
    return lambda r: r[name]


def nest_daily(rows: DataFrame, group_cols: list[str], with_code: bool = False) -> DataFrame:
    """Rows -> one payload ``daily`` struct of parallel arrays per group.

    Callers group by (location, bounded chunk) so the collected list is
    bounded by the chunk's calendar span.
    """
    canon = list(PROVIDER)                      # date + 7 measures
    value = [F.col("date").cast("string").alias("date")] + [F.col(c) for c in canon[1:]]
    if with_code:
        value.append(F.col("weather_code"))
    names = canon + (["weather_code"] if with_code else [])
    agg = rows.groupBy(*group_cols).agg(F.array_sort(F.collect_list(F.struct(*value))).alias("_r"))
    arrays = [F.transform("_r", _field(n)).alias(PROVIDER.get(n, n)) for n in names]
    return agg.select(*group_cols, F.struct(*arrays).alias("daily"))


def last_rows(rows: DataFrame, n: int, key: str = "location_id", order: str = "date") -> DataFrame:
    """K2: the last ``n`` rows per series (plans a WindowGroupLimit)."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_rb", F.row_number().over(w)).where(F.col("_rb") <= n).drop("_rb")


def cached_payload_rows(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stand-in daily rows for locations without a live payload.

    Last 41 stored rows per location, kept only if at least 30 exist; weather
    code 0.  Live rows pass through; ``source`` tells them apart.
    """
    live_keys = live.select("location_id").distinct()
    tail = last_rows(stored.join(live_keys, "location_id", "left_anti"), FALLBACK_ROWS)
    counted = tail.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("location_id")))
    cached = (counted.where(F.col("_n") >= FALLBACK_MIN_ROWS).drop("_n")
              .withColumn("weather_code", F.lit(0)).withColumn("source", F.lit("cached")))
    cols = ["location_id", "date", *RAW_ORDER, "weather_code", "source"]
    return live.withColumn("source", F.lit("live")).select(cols).unionByName(cached.select(cols))


def cached_current(stored: DataFrame, live_keys: DataFrame) -> DataFrame:
    """The current block of places without a live payload, from their last stored row."""
    last = F.max_by(F.struct(*RAW_ORDER), "date")
    rows = (stored.join(live_keys.select("location_id").distinct(), "location_id", "left_anti")
            .groupBy("location_id").agg(last.alias("r")))
    block = {"temperature_2m": "temp_mean", "relative_humidity_2m": "humidity", "precipitation": "precipitation",
             "pressure_msl": "pressure", "wind_speed_10m": "wind_speed"}
    return rows.select("location_id", *[F.coalesce(F.col(f"r.{block[k]}"), F.lit(v)).alias(k)
                                        for k, v in CURRENT_DEFAULTS.items()])


def cached_hourly(stored: DataFrame, live_keys: DataFrame) -> DataFrame:
    """The hourly block of places without a live payload: their last stored days by the hour."""
    from stratus.functions.hourly import hourly_from_daily
    keys = live_keys.select("location_id").distinct()
    return hourly_from_daily(last_rows(stored.join(keys, "location_id", "left_anti"), FALLBACK_ROWS))
