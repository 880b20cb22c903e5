"""Hand-made edge fixtures (FIXTURES.md section 3)."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from stratus import schemas as S
from stratus.operators import alerts, features, scaling, split
from stratus.sources import payload


def series(spark, n, start="2020-01-01", loc="X", gaps=(), overrides=None):
    d0 = dt.date.fromisoformat(start)
    rows, day = [], 0
    for i in range(n):
        while day in gaps:
            day += 1
        r = {"location_id": loc, "date": d0 + dt.timedelta(days=day), "temp_max": 30.0 + i % 5,
             "temp_min": 20.0 + i % 3, "temp_mean": 25.0 + (i % 7) / 2, "humidity": 60.0 + i % 10,
             "precipitation": float(i % 4), "wind_speed": 10.0 + i % 6, "pressure": 1000.0 + i % 9}
        for (idx, col), val in (overrides or {}).items():
            if idx == i:
                r[col] = val
        rows.append(r)
        day += 1
    return spark.createDataFrame(rows, S.RAW_DAILY)


def processed_dates(df):
    return [r.date for r in features.engineer(df).orderBy("date").collect()]


def test_complete_40_keeps_10(spark):
    assert features.engineer(series(spark, 40)).count() == 10


def test_short_29_keeps_none(spark):
    assert features.engineer(series(spark, 29)).count() == 0


def test_null_measure_drops_own_row_and_lags(spark):
    df = series(spark, 60, overrides={(39, "precipitation"): None})   # day 40 (1-based)
    kept = set(processed_dates(df))
    missing = [d for d in processed_dates(series(spark, 60)) if d not in kept]
    d0 = dt.date(2020, 1, 1)
    assert sorted((d - d0).days + 1 for d in missing) == [40, 41, 43, 47]


def test_null_rolling_drops_30_rows(spark):
    df = series(spark, 80, overrides={(44, "pressure"): None})        # day 45
    d0 = dt.date(2020, 1, 1)
    kept = {(d - d0).days + 1 for d in processed_dates(df)}
    assert not any(45 <= k <= 74 for k in kept)
    assert 75 in kept and 44 in kept


def test_nan_measure_becomes_null_and_normal(spark, tmp_path):
    doc = {"location_id": "X", "fetched_at": "2024-01-01T00:00:00",
           "daily": {"time": ["2024-01-01"], "temperature_2m_max": [float("nan")],
                     "temperature_2m_min": [1.0], "temperature_2m_mean": [float("nan")],
                     "relative_humidity_2m_mean": [50.0], "precipitation_sum": [0.0],
                     "wind_speed_10m_max": [5.0], "pressure_msl_mean": [1010.0]}}
    p = tmp_path / "nan.json"
    p.write_text(json.dumps(doc))   # json.dumps writes NaN literals
    rows = payload.ingest_archive(spark.read.schema(S.ARCHIVE_PAYLOAD)
                                  .option("allowNonNumericNumbers", True).json(str(p)))
    r = alerts.with_alert(rows, "temp_mean", "humidity", "pressure", "precipitation").first()
    assert r.temp_mean is None and r.alert_level == "NORMAL"


def test_gap_day_lag_is_previous_row(spark):
    df = features.with_features(series(spark, 10, gaps=(5,)))
    rows = df.orderBy("date").collect()
    assert rows[5].temp_mean_lag_1 == rows[4].temp_mean
    assert (rows[5].date - rows[4].date).days == 2


def test_duplicate_date_newest_wins(spark):
    base = series(spark, 3).withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    newer = (series(spark, 1).withColumn("temp_max", F.lit(99.0))
             .withColumn("fetched_at", F.lit("2024-02-01").cast("timestamp")))
    out = payload.dedupe_daily(base.unionByName(newer)).orderBy("date").collect()
    assert len(out) == 3 and out[0].temp_max == 99.0


def test_constant_column_scales_to_zero(spark):
    df = series(spark, 60).withColumn("humidity", F.lit(50.0))
    s = split.with_split(features.engineer(df))
    stats = scaling.fit_minmax(s)
    scaled = scaling.apply_minmax(s, stats).where(F.col("split") == "train")
    assert {r.humidity_s for r in scaled.select("humidity_s").collect()} == {0.0}


def test_no_daily_block_is_rejected(spark, tmp_path):
    p = tmp_path / "nodaily.json"
    p.write_text(json.dumps({"location_id": "X", "fetched_at": "2024-01-01T00:00:00"}))
    pl = payload.read_archive(spark, str(p))
    assert payload.rejects(pl).count() == 1
    assert payload.daily_rows(pl).count() == 0


def test_ragged_payload_pads_with_null(spark, tmp_path):
    doc = {"location_id": "X", "fetched_at": "2024-01-01T00:00:00",
           "daily": {"time": ["2024-01-01", "2024-01-02"], "temperature_2m_max": [1.0],
                     "temperature_2m_min": [0.0, 0.0], "temperature_2m_mean": [0.5, 0.5],
                     "relative_humidity_2m_mean": [1.0, 2.0], "precipitation_sum": [0.0, 0.0],
                     "wind_speed_10m_max": [1.0, 1.0], "pressure_msl_mean": [1000.0, 1000.0]}}
    p = tmp_path / "ragged.json"
    p.write_text(json.dumps(doc))
    rows = payload.daily_rows(payload.read_archive(spark, str(p))).orderBy("date").collect()
    assert len(rows) == 2 and rows[1].temp_max is None


def alert_of(spark, t, h, p, rain):
    df = spark.createDataFrame([(t, h, p, rain)], "t double, h double, p double, r double")
    return alerts.with_alert(df, "t", "h", "p", "r").first()


def test_golden_export_is_normal(spark):
    r = alert_of(spark, 31.704, 53.0, 1002.1, 0.0)
    assert (r.alert_level, r.risk_pct) == ("NORMAL", 0.0)


@pytest.mark.parametrize("t,h,p,rain,level", [
    (37.0, 0.0, 1013.0, 0.0, "SEVERE HEAT WARNING"),
    (34.0, 70.0, 1013.0, 0.0, "SEVERE HEAT WARNING"),
    (34.0, 69.0, 1013.0, 0.0, "HEAT ADVISORY"),
    (33.0, 0.0, 1013.0, 0.0, "HEAT ADVISORY"),
    (10.0, 0.0, 1013.0, 0.0, "COLD ADVISORY"),
    (10.1, 0.0, 1007.9, 5.1, "BAROMETRIC PRESSURE ALERT"),
    (10.1, 0.0, 1008.0, 5.1, "NORMAL"),
    (10.1, 0.0, 1007.9, 5.0, "NORMAL"),
])
def test_alert_bounds(spark, t, h, p, rain, level):
    assert alert_of(spark, t, h, p, rain).alert_level == level


def test_alert_cards(spark):
    df = spark.createDataFrame([("a", "NORMAL", 5.0), ("b", "HEAT ADVISORY", 25.0), ("c", "SEVERE HEAT WARNING", 1.0)],
                               "k string, alert_level string, wind_speed double")
    out = {(r.k, r.alert_title, r.alert_colour) for r in alerts.alert_rows(df).collect()}
    assert out == {("a", S.ALL_CLEAR, S.ALERT_GREEN), ("b", "HEAT ADVISORY", S.ALERT_YELLOW),
                   ("b", S.WIND_CAUTION, S.ALERT_YELLOW), ("c", "SEVERE HEAT WARNING", S.ALERT_RED)}


def test_seasonal_encoding_matches_numpy(spark):
    df = series(spark, 40)
    r = features.with_features(df).orderBy("date").first()
    assert math.isclose(r.sin_day, math.sin(2 * math.pi * 1 / 365.25), abs_tol=1e-9)
    assert math.isclose(r.cos_month, math.cos(2 * math.pi * 1 / 12.0), abs_tol=1e-9)


@pytest.mark.parametrize("value,decimals,expected", [(2.5, 0, "2"), (3.5, 0, "4"), (0.25, 1, "0.2"),
                                                     (31.704, 1, "31.7"), (53.0, 0, "53")])
def test_display_rounding_is_half_even(spark, value, decimals, expected):
    from stratus.functions import timefmt
    out = spark.createDataFrame([(value,)], "v double").select(timefmt.fixed(F.col("v"), decimals, "")).first()[0]
    assert out == expected == f"{value:.{decimals}f}"


def test_place_label_skips_blanks_and_repeats(spark):
    from stratus.functions.places import place_label
    rows = [("Pune", "Maharashtra", "Pune", "India"), ("Goa", None, "", "India"), ("X", "X", None, None)]
    df = spark.createDataFrame(rows, "name string, admin1 string, admin2 string, country string")
    out = [r[0] for r in df.select(place_label(F.col("name"), F.col("admin1"), F.col("admin2"),
                                               F.col("country"))).collect()]
    assert out == ["Pune, Maharashtra, India", "Goa, India", "X"]


def test_current_defaults_for_missing_and_null(spark, tmp_path):
    docs = [{"location_id": "A", "fetched_at": "2024-01-01T00:00:00"},
            {"location_id": "B", "fetched_at": "2024-01-01T00:00:00",
             "current": {"temperature_2m": 30.5, "pressure_msl": None}}]
    p = tmp_path / "cur.json"
    p.write_text("\n".join(json.dumps(d) for d in docs))
    rows = {r.location_id: r for r in payload.current_obs(payload.read_forecast(spark, str(p))).collect()}
    assert (rows["A"].temperature_2m, rows["A"].pressure_msl, rows["A"].relative_humidity_2m) == (0.0, 1013.0, 0.0)
    assert (rows["B"].temperature_2m, rows["B"].pressure_msl) == (30.5, 1013.0)


def test_hourly_block_parses_local_times(spark, tmp_path):
    doc = {"location_id": "A", "fetched_at": "2024-01-01T00:00:00",
           "hourly": {"time": ["2024-01-15T06:00", "2024-01-15T07:00"], "temperature_2m": [1.0, 2.0],
                      "weather_code": [3]}}
    p = tmp_path / "hourly.json"
    p.write_text(json.dumps(doc))
    rows = payload.hourly_rows(payload.read_forecast(spark, str(p))).orderBy("ts").collect()
    assert [r.ts for r in rows] == [dt.datetime(2024, 1, 15, 6), dt.datetime(2024, 1, 15, 7)]
    assert rows[1].weather_code is None and rows[1].temperature_2m == 2.0


def test_copy_without_fetch_time_ranks_oldest(spark):
    a = series(spark, 2).withColumn("fetched_at", F.lit(None).cast("timestamp"))
    b = (series(spark, 1).withColumn("temp_max", F.lit(55.0))
         .withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp")))
    out = payload.dedupe_daily(a.unionByName(b)).orderBy("date").collect()
    assert [r.temp_max for r in out] == [55.0, 31.0]
    only_null = payload.dedupe_daily(a).orderBy("date").collect()
    assert all(r.temp_max is not None for r in only_null)


def test_single_place_csv_layout(spark, tmp_path):
    from stratus.sources import files
    p = tmp_path / "raw_weather.csv"
    p.write_text("date,temp_max,temp_min,temp_mean,humidity,precipitation,wind_speed,pressure\n"
                 "2024-07-01,33.0,25.0,29.0,53.0,0.0,18.1,1002.1\n")
    r = files.read_raw_csv(spark, str(p), location_id="here").first()
    assert (r.location_id, r.date, r.temp_mean, r.pressure) == ("here", dt.date(2024, 7, 1), 29.0, 1002.1)
