"""Dashboard tables as DataFrames, for every location at once.

All positional slices are per-location windows (hash-partitioned on
location_id); none uses a global ordering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratus.functions import codes, timefmt
from stratus.operators.features import series_window
from stratus.schemas import CONTEXT_DAYS


def with_clock(rows: DataFrame, as_of_ts: str, offsets: DataFrame | None) -> DataFrame:
    """Add ``_now``: the place's wall clock at a UTC instant (F5), or the instant itself
    without ``offsets`` (location_id, utc_offset_seconds).  Places that have no offset
    there take the default."""
    instant = F.lit(as_of_ts).cast("timestamp_ntz")
    if offsets is None:
        return rows.withColumn("_now", instant)
    return (rows.join(offsets.select("location_id", "utc_offset_seconds"), "location_id", "left")
            .withColumn("_now", timefmt.local_time(instant, F.col("utc_offset_seconds"))).drop("utc_offset_seconds"))


def next_hours(hourly: DataFrame, as_of_ts: str, hours: int = 24, offsets: DataFrame | None = None) -> DataFrame:
    """``hours`` rows from the place's current hour; from the first row if absent."""
    hourly = with_clock(hourly, as_of_ts, offsets)
    now_hour = F.date_trunc("hour", F.col("_now")).cast("timestamp_ntz")
    whole = Window.partitionBy("location_id")
    start = F.coalesce(F.min(F.when(F.col("ts") == now_hour, F.col("ts"))).over(whole),
                       F.min("ts").over(whole))
    after = hourly.withColumn("_start", start).where(F.col("ts") >= F.col("_start"))
    ranked = after.withColumn("_rn", F.row_number().over(series_window(order="ts")))
    return ranked.where(F.col("_rn") <= hours).drop("_start", "_rn", "_now")


def hourly_table(rows: DataFrame) -> DataFrame:
    """The hourly timeline with labels and formatted values."""
    labelled = codes.with_condition(rows, "weather_code", "condition", "icon")
    return labelled.select(
        "location_id", "ts",
        timefmt.hour_label(F.col("ts")).alias("hour"),
        "icon", "condition",
        timefmt.fixed(F.col("temperature_2m"), 1, "°C").alias("temperature"),
        timefmt.fixed(F.col("relative_humidity_2m"), 0, "%").alias("humidity"),
        timefmt.fixed(F.col("wind_speed_10m"), 1, " km/h").alias("wind_speed"),
        timefmt.integer_text(F.col("precipitation_probability"), "%").alias("rain_prob"))


def _positions(rows: DataFrame, as_of: str, offsets: DataFrame | None) -> DataFrame:
    whole = Window.partitionBy("location_id")
    rows = with_clock(rows, as_of, offsets)
    today = F.col("_now").cast("date")
    return rows.withColumns({
        "_rn": F.row_number().over(series_window()),
        "_n": F.count(F.lit(1)).over(whole),
    }).withColumn("_today_rn", F.min(F.when(F.col("date") == today, F.col("_rn"))).over(whole))


def ten_days(rows: DataFrame, as_of: str, days: int = 10, offsets: DataFrame | None = None) -> DataFrame:
    """``days`` rows from the place's today; if today is absent, the last ``days`` rows."""
    pos = _positions(rows, as_of, offsets)
    start = F.coalesce(F.col("_today_rn"), F.greatest(F.lit(1), F.col("_n") - (days - 1)))
    kept = pos.where((F.col("_rn") >= start) & (F.col("_rn") < start + days))
    labelled = codes.with_condition(kept, "weather_code", "condition", "icon")
    return labelled.select("location_id", "date", timefmt.day_label(F.col("date")).alias("day"),
                           "temp_max", "temp_min", "icon", "condition")


def today_range(rows: DataFrame, as_of: str, offsets: DataFrame | None = None) -> DataFrame:
    """today's high/low; else the 10th row from the end (or the first)."""
    pos = _positions(rows, as_of, offsets)
    pick = F.coalesce(F.col("_today_rn"), F.when(F.col("_n") >= 10, F.col("_n") - 9).otherwise(F.lit(1)))
    return pos.where(F.col("_rn") == pick).select(
        "location_id", "date", F.col("temp_max").alias("today_max"), F.col("temp_min").alias("today_min"),
        F.col("_today_rn").isNotNull().alias("matched_today"))


def context_series(rows: DataFrame, forecasts: DataFrame, days: int = CONTEXT_DAYS,
                   as_of: str | None = None) -> DataFrame:
    """W12 + U1: last ``days`` daily means before the final row, the forecast
    point, and the two-point link from the last actual to the forecast.

    With ``as_of`` (Q11) the series ends the day before it instead: no row is dropped
    for its position, and no forecast row of the payload counts as actual.
    """
    if as_of is not None:      # the day itself stands in for the final row that is left out
        rows = rows.where(F.col("date") <= F.lit(as_of).cast("date"))
    w_desc = Window.partitionBy("location_id").orderBy(F.col("date").desc())
    ranked = rows.withColumn("_rb", F.row_number().over(w_desc)).where(F.col("_rb").between(2, days + 1))
    point = lambda kind: F.struct(F.col("date"), F.col("temp_mean").alias("value"), F.lit(kind).alias("kind"))
    actual = ranked.select("location_id", F.inline(F.array_compact(F.array(
        point("actual"), F.when(F.col("_rb") == 2, point("link"))))))
    fc = (forecasts.join(ranked.where(F.col("_rb") == 2).select("location_id"), "location_id", "left")
          .select(forecasts["location_id"].alias("location_id"), F.col("forecast_date").alias("date"),
                  F.col("forecast_temp").alias("value"),
                  ranked["location_id"].isNotNull().alias("_linked")))
    fpoint = lambda kind: F.struct(F.col("date"), F.col("value"), F.lit(kind).alias("kind"))
    fc_rows = fc.select("location_id", F.inline(F.array_compact(F.array(
        fpoint("forecast"), F.when(F.col("_linked"), fpoint("link"))))))
    return actual.unionByName(fc_rows)


def history_range(rows: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """P5: inclusive date range (pushed to the scan); all rows if incomplete."""
    if start is None or end is None:
        return rows
    return rows.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def range_summary(rows: DataFrame) -> DataFrame:
    """First date, last date and day count per location."""
    return rows.groupBy("location_id").agg(F.min("date").alias("first_date"),
                                           F.max("date").alias("last_date"),
                                           F.count(F.lit(1)).alias("days"))


PARAMETERS = {
    "Temperature (°C)": ["temp_max", "temp_mean", "temp_min"],
    "Humidity (%)": ["humidity"],
    "Wind Speed (km/h)": ["wind_speed"],
    "Pressure (hPa)": ["pressure"],
    "Precipitation (mm)": ["precipitation"],
}


def history_long(rows: DataFrame, parameter: str) -> DataFrame:
    """The chosen parameter's series in long form (series, value)."""
    cols = PARAMETERS.get(parameter, PARAMETERS["Precipitation (mm)"])
    return rows.unpivot(["location_id", "date"], cols, "series", "value")
