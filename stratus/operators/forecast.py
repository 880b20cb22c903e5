"""Next-day forecast assembly for every location.

Dimension joins here are on location_id.  Their size grows with the number
of locations, so no broadcast is forced: Catalyst broadcasts them only while
their estimated size is under ``autoBroadcastJoinThreshold`` and AQE re-plans
with runtime sizes.  The WMO table (28 rows) is the only forced broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.functions import codes, places, timefmt
from stratus.operators import alerts
from stratus.operators.features import complete_features, with_features
from stratus.schemas import TABULAR_FEATURES
from stratus.sources.payload import last_rows


def up_to(rows: DataFrame, as_of: str) -> DataFrame:
    """Rows on or before the as-of date."""
    return rows.where(F.col("date") <= F.lit(as_of).cast("date"))


def latest_complete(rows: DataFrame, as_of: str, features: list[str] | None = None) -> DataFrame:
    """Per location the latest row up to ``as_of`` whose features are complete.

    Adds ``latest_obs_date`` and ``forecast_date`` (F11, = latest + 1 day).
    """
    feats = complete_features(with_features(up_to(rows, as_of), target=False), features or TABULAR_FEATURES)
    last = last_rows(feats, 1)
    return last.withColumns({"latest_obs_date": F.col("date"),
                             "forecast_date": timefmt.next_day(F.col("date"))})


def tomorrow_condition(forecasts: DataFrame, daily_rows: DataFrame, current: DataFrame) -> DataFrame:
    """J1 + P12: the forecast day's weather label, or the fallback cascade.

    The cascade decides when the day is missing or the feed has no codes at all; a
    null code of a feed that has codes is ``Unknown``.
    """
    day = daily_rows.select("location_id", F.col("date").alias("forecast_date"), "weather_code",
                            F.col("has_codes").alias("_matched"))
    joined = (forecasts.select("location_id", "forecast_date")
              .join(day, ["location_id", "forecast_date"], "left")
              .join(current, "location_id", "left"))
    labelled = codes.with_condition(joined, "weather_code", "_label")
    fallback = alerts.condition_fallback(F.col("precipitation"), F.col("wind_speed_10m"),
                                         F.col("relative_humidity_2m"))
    matched = F.coalesce("_matched", F.lit(False))
    return (labelled.withColumn("condition", F.when(matched, F.col("_label")).otherwise(fallback))
            .select("location_id", "forecast_date", "condition"))


def choose_forecast(forecasts: DataFrame, best: DataFrame) -> DataFrame:
    """Keep each location's forecast from its registered best model."""
    return forecasts.join(best.select("location_id", F.col("best_model").alias("model")),
                          ["location_id", "model"])


def forecast_rejects(forecasts: DataFrame, best: DataFrame) -> DataFrame:
    """Places whose registered best model gave no forecast (absent from :func:`choose_forecast`)."""
    made = forecasts.select("location_id", "model").distinct()
    wanted = best.select("location_id", F.col("best_model").alias("model"))
    return (wanted.join(made, ["location_id", "model"], "left_anti")
            .select("location_id", "model", F.lit("no forecast by the best model").alias("reason")))


def export_rows(chosen: DataFrame, current: DataFrame, locs: DataFrame, stamp: str) -> DataFrame:
    """J4 + P8: the forecast/alert document, one row per location."""
    label = places.place_label(F.col("name"), F.col("admin1"), F.col("admin2"), F.col("country"))
    df = (chosen.join(current, "location_id", "left")
          .join(locs, "location_id", "left"))
    a = alerts.alert(F.col("forecast_temp"), F.col("relative_humidity_2m"), F.col("pressure_msl"),
                     F.col("precipitation"))
    return df.withColumn("_a", a).select(
        "location_id",
        label.alias("location"),
        timefmt.coordinates(F.col("latitude"), F.col("longitude")).alias("coordinates"),
        F.col("temperature_2m").alias("temp_today"),
        F.col("forecast_temp").alias("temp_tomorrow"),
        F.col("relative_humidity_2m").alias("humidity"),
        F.col("wind_speed_10m").alias("wind_speed"),
        F.col("pressure_msl").alias("pressure"),
        F.col("precipitation"),
        F.col("model").alias("model_used"),
        F.col("_a.level").alias("biometeorological_alert"),
        F.col("_a.risk").alias("risk_penalty_percentage"),
        F.col("_a.guideline").alias("health_guidelines"),
        F.lit(stamp).alias("timestamp"))
