"""Time arithmetic and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratus.schemas import DEFAULT_UTC_OFFSET_SECONDS


def local_time(utc_ts: Column, offset_seconds: Column) -> Column:
    """UTC wall clock (TIMESTAMP_NTZ) shifted by the payload's offset (default +05:30).

    Wall-clock arithmetic on TIMESTAMP_NTZ does not depend on the session time zone.
    """
    secs = F.coalesce(offset_seconds, F.lit(DEFAULT_UTC_OFFSET_SECONDS))
    return utc_ts + F.make_interval(secs=secs.cast("decimal(18,6)"))


def clock_label(ts: Column) -> Column:
    """Header clock, e.g. ``Jan 05, 2024 | 03:07 PM``."""
    return F.date_format(ts, "MMM dd, yyyy | hh:mm a")


def hour_label(ts: Column) -> Column:
    """``03:00 PM``."""
    return F.date_format(ts, "hh:00 a")


def day_label(d: Column) -> Column:
    """``Friday, Jan 05``."""
    return F.date_format(d, "EEEE, MMM dd")


def fixed(value: Column, decimals: int, suffix: str) -> Column:
    """F8: ``{value:.Nf}{suffix}`` with Python's half-to-even rounding."""
    return F.format_string(f"%.{decimals}f{suffix.replace('%', '%%')}", F.bround(value, decimals))


def integer_text(value: Column, suffix: str) -> Column:
    return F.format_string(f"%d{suffix.replace('%', '%%')}", value)


def coordinates(lat: Column, lon: Column) -> Column:
    """``lat,lon``."""
    return F.concat_ws(",", lat.cast("string"), lon.cast("string"))


def next_day(d: Column) -> Column:
    """the date after the last complete observation."""
    return F.date_add(d, 1)
