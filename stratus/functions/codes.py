"""WMO weather-code lookup as a broadcast dimension join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.schemas import WMO_CODES, WMO_UNKNOWN


def wmo_dimension(spark: SparkSession) -> DataFrame:
    """The 28-row code table (fixed size, so broadcasting it is always safe)."""
    return spark.createDataFrame(WMO_CODES, "wmo_code int, wmo_icon string, wmo_label string")


def with_condition(df: DataFrame, code_col: str = "weather_code", label: str = "condition",
                   icon: str | None = None) -> DataFrame:
    """Left-join the code table; unknown or null codes get the Unknown label."""
    dim = F.broadcast(wmo_dimension(df.sparkSession))
    out = df.join(dim, F.col(code_col) == F.col("wmo_code"), "left")
    cols: dict[str, Column] = {label: F.coalesce(F.col("wmo_label"), F.lit(WMO_UNKNOWN[1]))}
    if icon:
        cols[icon] = F.coalesce(F.col("wmo_icon"), F.lit(WMO_UNKNOWN[0]))
    return out.withColumns(cols).drop("wmo_code", "wmo_icon", "wmo_label")


def wmo_values_sql() -> str:
    """The same table as a SQL VALUES list (for SQL users and the oracle)."""
    rows = ", ".join(f"({c}, '{icon}', '{lbl}')" for c, icon, lbl in WMO_CODES)
    return f"(values {rows}) as wmo(wmo_code, wmo_icon, wmo_label)"
