"""Alert cascade, wind caution, severity colour, air quality, condition fallback.

All are row-local CASE expressions inside whole-stage codegen.  Inputs are
null-safe: a null (or NaN turned null at ingest) temperature falls through to
NORMAL, as a NaN comparison does in the originating application.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratus import schemas as S


def _alert(spec: tuple[str, float, str]) -> Column:
    level, risk, text = spec
    return F.struct(F.lit(level).alias("level"), F.lit(risk).alias("risk"), F.lit(text).alias("guideline"))


def alert(temp: Column, humidity: Column, pressure: Column, rain: Column) -> Column:
    """First matching rule wins -> struct(level, risk, guideline)."""
    return (F.when((temp >= S.SEVERE_HEAT_T)
                   | ((temp >= S.SEVERE_HEAT_T_HUMID) & (humidity >= S.SEVERE_HEAT_HUMIDITY)),
                   _alert(S.ALERT_SEVERE_HEAT))
            .when(temp >= S.HEAT_T, _alert(S.ALERT_HEAT))
            .when(temp <= S.COLD_T, _alert(S.ALERT_COLD))
            .when((pressure < S.PRESSURE_LOW) & (rain > S.PRESSURE_RAIN), _alert(S.ALERT_PRESSURE))
            .otherwise(_alert(S.ALERT_NORMAL)))


def with_alert(df: DataFrame, temp: str, humidity: str, pressure: str, rain: str) -> DataFrame:
    a = alert(F.col(temp), F.col(humidity), F.col(pressure), F.col(rain))
    return (df.withColumn("_a", a)
            .withColumns({"alert_level": F.col("_a.level"), "risk_pct": F.col("_a.risk"),
                          "guideline": F.col("_a.guideline")}).drop("_a"))


def severity_colour(level: Column) -> Column:
    """P10: red when the level names SEVERE or WARNING, else yellow."""
    return F.when(level.rlike("SEVERE|WARNING"), F.lit(S.ALERT_RED)).otherwise(F.lit(S.ALERT_YELLOW))


def alert_rows(df: DataFrame, level: str = "alert_level", wind: str = "wind_speed") -> DataFrame:
    """One output row per active alert; one all-clear row when none is.

    ``explode`` of a small fixed array is row-local (no shuffle).
    """
    card = lambda title, colour: F.struct(title.alias("title"), colour.alias("colour"))
    bio = F.when(F.col(level) != S.ALERT_NORMAL[0], card(F.col(level), severity_colour(F.col(level))))
    gust = F.when(F.col(wind) > S.HIGH_WIND, card(F.lit(S.WIND_CAUTION), F.lit(S.ALERT_YELLOW)))
    active = F.array_compact(F.array(bio, gust))
    cards = F.when(F.size(active) > 0, active).otherwise(
        F.array(card(F.lit(S.ALL_CLEAR), F.lit(S.ALERT_GREEN))))
    return (df.withColumn("_card", F.explode(cards))
            .withColumns({"alert_title": F.col("_card.title"), "alert_colour": F.col("_card.colour")})
            .drop("_card"))


def air_quality(humidity: Column) -> Column:
    """Humidity proxy."""
    return F.when(humidity > S.HUMID_AIR, F.lit(S.AIR_MODERATE)).otherwise(F.lit(S.AIR_GOOD))


def condition_fallback(rain: Column, wind: Column, humidity: Column) -> Column:
    """Label used when no weather code exists for the forecast day."""
    return (F.when(rain > S.WET_RAIN, F.lit(S.COND_WET))
            .when(wind > S.HIGH_WIND, F.lit(S.COND_WINDY))
            .when(humidity > S.HUMID_AIR, F.lit(S.COND_HUMID))
            .otherwise(F.lit(S.COND_DEFAULT)))
