"""Feature engineering over daily series.

All positional operators share one window specification, so Catalyst plans a
single Exchange(hashpartitioning(location_id)) + Sort + Window node for the
target, the 21 lags and the 6 rolling means together.

Scale: the key (location_id, date) is unique (enforced by
``sources.payload.dedupe_daily``), so one location contributes at most one row
per calendar day -- about 36,600 rows per century.  A window partition is
therefore bounded by the calendar span, not by the data volume; a hot
location cannot grow a single task beyond that bound.  Data volume grows with
the number of locations, which is the hash-partitioned axis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratus.schemas import LAGS, MEASURES, ROLL_COLUMNS, ROLL_WINDOWS, TABULAR_FEATURES, TARGET


def series_window(key: str = "location_id", order: str = "date"):
    """Window over one series in time order (never without partitionBy)."""
    return Window.partitionBy(key).orderBy(order)


def rolling_mean(col: str, n: int, w) -> Column:
    """Mean of the last ``n`` rows (current included); null unless all ``n`` are present."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col).over(frame) == n, F.avg(col).over(frame))


# The JVM's and C's sin/cos may differ in the last bit; rounding the encodings
# to 1e-9 (far below the float32 precision sequence models train at) makes
# every engine produce the same bits.
ENCODING_DIGITS = 9


def cyclic(value: Column, period: float, fn) -> Column:
    return F.round(fn(F.lit(2.0) * F.pi() * value / period), ENCODING_DIGITS)


def seasonal_columns(date_col: str = "date") -> dict[str, Column]:
    """Month, day of year and their cyclic encodings."""
    m = F.month(date_col)
    d = F.dayofyear(date_col)
    return {
        "month": m,
        "day_of_year": d,
        "sin_month": cyclic(m, 12.0, F.sin),
        "cos_month": cyclic(m, 12.0, F.cos),
        "sin_day": cyclic(d, 365.25, F.sin),
        "cos_day": cyclic(d, 365.25, F.cos),
    }


def lag_columns(w) -> dict[str, Column]:
    return {f"{c}_lag_{k}": F.lag(c, k).over(w) for k in LAGS for c in MEASURES}


def rolling_columns(w) -> dict[str, Column]:
    return {f"{c}_roll_mean_{n}": rolling_mean(c, n, w) for n in ROLL_WINDOWS for c in ROLL_COLUMNS}


def with_features(df: DataFrame, key: str = "location_id", order: str = "date",
                  target: bool = True) -> DataFrame:
    """Add target, lags, rolling means and seasonal columns (no rows dropped).

    Output column order: keys, 7 measures, target, 21 lags, 6 rolling means,
    6 seasonal columns; extra input columns follow the measures.
    """
    w = series_window(key, order)
    cols: dict[str, Column] = {}
    if target:
        cols[TARGET] = F.lead("temp_mean", 1).over(w)
    cols.update(lag_columns(w))
    cols.update(rolling_columns(w))
    cols.update(seasonal_columns(order))
    out = df.withColumns(cols)
    front = [key, order] + [c for c in df.columns if c not in (key, order)]
    return out.select(*front, *cols.keys())


def complete_rows(df: DataFrame) -> DataFrame:
    """Keep rows without any null (NaN was turned into null at ingest)."""
    return df.na.drop("any")


def complete_features(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Keep rows whose model inputs are present (the target may be null)."""
    return df.na.drop("any", subset=features or TABULAR_FEATURES)


def engineer(raw: DataFrame) -> DataFrame:
    """Processed training table: features over raw daily rows, then P2."""
    return complete_rows(with_features(raw))


def row_loss(raw: DataFrame) -> DataFrame:
    """Rows in, dropped, kept per location -- one aggregate after the window."""
    feats = with_features(raw)
    complete = F.lit(True)
    for c in feats.columns:
        complete = complete & F.col(c).isNotNull()
    return (feats.groupBy("location_id")
            .agg(F.count(F.lit(1)).alias("rows_in"),
                 F.count_if(~complete).alias("rows_dropped"),
                 F.count_if(complete).alias("rows_kept")))

