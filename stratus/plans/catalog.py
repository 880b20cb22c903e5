"""Named query plans: each takes (spark, sf_dir) and returns a DataFrame.

``QUERIES`` maps names to plan builders; ``ORACLES`` maps the same names to
DuckDB SQL over the base tables.  Names without an oracle are model, tuning
and streaming plans whose outputs are not expressible in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus import oracle as O
from stratus.functions import codes, places, timefmt
from stratus.functions.hourly import hourly_from_daily
from stratus.operators import alerts, forecast, metrics, scaling, sequences, split, views
from stratus.operators import features as feat
from stratus.schemas import (HISTORY_DAYS, HISTORY_DELAY_DAYS, LAG_COLUMNS, RAW_ORDER,
                             ROLL_MEAN_COLUMNS, SEASONAL, SEQUENCE_FEATURES, TABULAR_FEATURES, TARGET)
from stratus.session import scratch_path
from stratus.sources import files, payload
from stratus.sources import fixtures as fx

AS_OF = fx.AS_OF_DAILY
SEQ_LEN = 7
LONG_SEQ_LEN = 500
HISTORY_START, HISTORY_END = "1996-01-01", "2000-12-31"
UTC_CLOCK = fx.AS_OF_HOURLY
LATE_CLOCK = f"{AS_OF} 20:00:00"
EXPORT_STAMP = f"{AS_OF} 00:00:00"


# ---------------------------------------------------------------- shared inputs
def processed(spark, sf_dir, by="region") -> DataFrame:
    return feat.engineer(fx.raw_daily(spark, sf_dir, by))


def split_processed(spark, sf_dir, by="region") -> DataFrame:
    return split.with_split(processed(spark, sf_dir, by))


def scaled_processed(spark, sf_dir, by="region") -> DataFrame:
    return scaling.with_minmax(split_processed(spark, sf_dir, by))


def _per_model(rows: DataFrame, keep: list[str], models: list[tuple[str, str, object]],
               value: str) -> DataFrame:
    """One output row per (input row, model) from a single pass (no union of
    two scans of the same upstream)."""
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(r).alias("role"), v.alias(value))
                    for m, r, v in models])
    return rows.select(*keep, F.inline(arr))


def stand_ins() -> list[tuple[str, str, object]]:
    """(model, role, prediction) of the two deterministic stand-in models."""
    return [("persistence", "baseline", F.col("temp_mean")),
            ("midpoint", "sequence", (F.col("temp_max") + F.col("temp_mean_lag_1")) / 2)]


def fixture_predictions(spark, sf_dir, by="region") -> DataFrame:
    """Deterministic stand-in predictions on the test rows (exact oracles)."""
    test = split_processed(spark, sf_dir, by).where(F.col("split") == "test")
    out = _per_model(test, ["location_id", "date", F.col(TARGET).alias("actual")], stand_ins(), "predicted")
    return out.select("location_id", "model", "role", "date", "actual", "predicted")


def payload_daily(spark, sf_dir) -> DataFrame:
    return payload.dedupe_daily(payload.daily_rows(fx.forecast_payloads(spark, sf_dir, AS_OF), with_code=True))


def without_flag(rows: DataFrame) -> DataFrame:
    return rows.drop("has_codes")


def payload_current(spark, sf_dir) -> DataFrame:
    return payload.current_obs(fx.forecast_payloads(spark, sf_dir, AS_OF)).drop("fetched_at",
                                                                               "utc_offset_seconds")


def payload_rows(spark, sf_dir) -> DataFrame:
    """What live forecasts read: the payload's 41 days, never the whole history."""
    return payload_daily(spark, sf_dir).drop("weather_code", "has_codes")


def stand_in_forecasts(spark, sf_dir, rows=None) -> DataFrame:
    """Both stand-in models' next-day forecasts from the latest complete payload row."""
    latest = forecast.latest_complete(payload_rows(spark, sf_dir) if rows is None else rows, AS_OF)
    out = _per_model(latest, ["location_id", "latest_obs_date", "forecast_date"], stand_ins(), "forecast_temp")
    return out.drop("role")


# ---------------------------------------------------------------- S: sources / sinks
def q_raw_daily(spark, sf_dir):
    """Raw table through the CSV sink and a typed CSV scan."""
    path = scratch_path(spark, "raw-csv")
    files.write_raw_csv(fx.raw_daily(spark, sf_dir), path)
    return files.read_raw_csv(spark, path)


def q_csv_ingest(spark, sf_dir):
    """Two CSV deliveries with NaN and repeated days -> the normalised raw table."""
    path = scratch_path(spark, "csv-deliveries")
    fx.land_csv_deliveries(spark, sf_dir, path)
    return files.read_raw_csv(spark, path)


def q_archive_ingest(spark, sf_dir):
    """Archive payload JSON -> rows, rejects split, newest fetch wins."""
    path = scratch_path(spark, "archive-payload")
    fx.land_archive_payloads(spark, sf_dir, path)
    return payload.ingest_archive(payload.read_archive(spark, path))


def q_archive_rejects(spark, sf_dir):
    path = scratch_path(spark, "archive-payload")
    fx.land_archive_payloads(spark, sf_dir, path)
    return payload.rejects(payload.read_archive(spark, path)).select("location_id", "reason")


def q_history_window(spark, sf_dir):
    """The 5x365-day archive window ending 5 days before as_of."""
    cut = F.lit(AS_OF).cast("date")
    return fx.raw_daily(spark, sf_dir).where(F.col("date").between(
        F.date_sub(cut, HISTORY_DAYS + HISTORY_DELAY_DAYS), F.date_sub(cut, HISTORY_DELAY_DAYS)))


def q_payload_daily(spark, sf_dir):
    """Forecast payload daily block (41 days incl. weather code) -> rows."""
    return without_flag(payload_daily(spark, sf_dir))


def q_current_obs(spark, sf_dir):
    """Current observation with defaults."""
    return payload_current(spark, sf_dir)


def q_payload_hourly(spark, sf_dir):
    """Hourly forecast blocks -> one row per hour."""
    path = scratch_path(spark, "hourly-payload")
    fx.land_hourly_payloads(spark, sf_dir, path)
    return payload.hourly_rows(payload.read_forecast(spark, path)).drop("fetched_at")


def q_processed_roundtrip(spark, sf_dir):
    """Processed table through the location-bucketed Parquet sink and scan."""
    path = scratch_path(spark, "processed")
    files.write_processed(processed(spark, sf_dir), path)
    return files.read_processed(spark, path)


def q_active_coordinates(spark, sf_dir):
    """Registry texts -> active location label and coordinates; defaults
    when blank or malformed."""
    lat, lon = files.parse_coordinates(F.col("coordinates"))
    return fx.coordinate_texts(spark, sf_dir).select("location_id", files.location_name(F.col("label"))
                                                     .alias("location"), lat.alias("latitude"),
                                                     lon.alias("longitude"))


def q_cached_payload(spark, sf_dir):
    """Live payload rows, plus stand-in rows built from the whole stored
    table for locations whose live fetch failed."""
    live = payload_daily(spark, sf_dir).where(fx.live_feed_ok(F.col("location_id")))
    return payload.cached_payload_rows(fx.raw_daily(spark, sf_dir), live)


# ---------------------------------------------------------------- W / F: features
def q_features_full(spark, sf_dir, by="region"):
    """The processed training table."""
    return processed(spark, sf_dir, by)


def q_lag_features(spark, sf_dir):
    w = feat.series_window()
    return fx.raw_daily(spark, sf_dir).select("location_id", "date", *[
        c.alias(n) for n, c in feat.lag_columns(w).items()])


def q_rolling_means(spark, sf_dir):
    w = feat.series_window()
    return fx.raw_daily(spark, sf_dir).select("location_id", "date", *[
        c.alias(n) for n, c in feat.rolling_columns(w).items()])


def q_seasonal(spark, sf_dir):
    return fx.raw_daily(spark, sf_dir).select("location_id", "date", *[
        c.alias(n) for n, c in feat.seasonal_columns().items()])


def q_row_loss(spark, sf_dir, by="region"):
    """A8."""
    return feat.row_loss(fx.raw_daily(spark, sf_dir, by))


# ---------------------------------------------------------------- split, scaling, sequences
def q_chrono_split(spark, sf_dir, by="region"):
    """W4."""
    return split_processed(spark, sf_dir, by).select("location_id", "date", "rn", "n", "split_at", "split")


def q_split_summary(spark, sf_dir):
    """A7."""
    return split.split_summary(split_processed(spark, sf_dir))


def q_minmax_stats(spark, sf_dir):
    """A5."""
    return scaling.fit_minmax(split_processed(spark, sf_dir))


def q_scaled_features(spark, sf_dir, by="region"):
    """M4."""
    cols = [f"{c}_s" for c in SEQUENCE_FEATURES + [TARGET]]
    return scaled_processed(spark, sf_dir, by).select("location_id", "date", "split", *cols)


def q_sequence_rejects(spark, sf_dir, by="supplier"):
    """Q7: places too short for a training window of ``LONG_SEQ_LEN`` days."""
    return sequences.sequence_rejects(split_processed(spark, sf_dir, by), LONG_SEQ_LEN)


def q_sequence_ends(spark, sf_dir, by="region"):
    """One row per sequence end with its split and window summary."""
    seq = sequences.with_sequences(scaled_processed(spark, sf_dir, by), SEQ_LEN)
    last = SEQ_LEN - 1
    return seq.select(
        "location_id", "date", "rn", "seq_split",
        F.size("seq").alias("seq_rows"),
        F.col("seq")[0][0].alias("first_temp_mean_s"),
        F.col("seq")[last][0].alias("last_temp_mean_s"),
        F.col("seq")[0][6].alias("first_pressure_s"),
        F.col("seq")[last][10].alias("last_cos_day_s"),
        F.col(f"{TARGET}_s"), F.col(TARGET))


def q_latest_complete(spark, sf_dir, by="region"):
    """Latest complete feature row up to as_of, per location."""
    latest = forecast.latest_complete(fx.raw_daily(spark, sf_dir, by), AS_OF)
    return latest.select("location_id", "latest_obs_date", "forecast_date", *TABULAR_FEATURES)


def q_latest_sequence(spark, sf_dir, by="region"):
    """Last L complete rows up to as_of."""
    ok, _ = sequences.latest_sequence(fx.raw_daily(spark, sf_dir, by), AS_OF, SEQ_LEN)
    return ok.select("location_id", "seq_rows", "seq_start", "seq_end",
                     F.col("seq")[0][0].alias("first_temp_mean"),
                     F.col("seq")[SEQ_LEN - 1][0].alias("last_temp_mean"),
                     F.col("seq")[SEQ_LEN - 1][10].alias("last_cos_day"))


# ---------------------------------------------------------------- P: alerts and labels
def _daily_alerts(spark, sf_dir, by="region"):
    return alerts.with_alert(fx.daily(spark, sf_dir, by), "temp_mean", "humidity", "pressure", "precipitation")


def q_alerts(spark, sf_dir, by="region"):
    """P8 on every daily row (temp_mean in place of the forecast)."""
    return _daily_alerts(spark, sf_dir, by).select("location_id", "date", "alert_level", "risk_pct", "guideline")


def q_alert_rows(spark, sf_dir):
    """One row per active alert card, or an all-clear card."""
    return alerts.alert_rows(_daily_alerts(spark, sf_dir)).select(
        "location_id", "date", "alert_title", "alert_colour")


def q_air_quality(spark, sf_dir):
    """P11."""
    return fx.daily(spark, sf_dir).select("location_id", "date",
                                          alerts.air_quality(F.col("humidity")).alias("air_quality"))


def q_conditions(spark, sf_dir):
    """WMO label per daily row (broadcast 28-row dimension)."""
    return codes.with_condition(fx.daily(spark, sf_dir).select("location_id", "date", "weather_code"))


def q_tomorrow_condition(spark, sf_dir):
    """Forecast-day label from the payload, else the fallback cascade."""
    fc = forecast.latest_complete(payload_rows(spark, sf_dir), AS_OF).select("location_id", "forecast_date")
    return forecast.tomorrow_condition(fc, payload_daily(spark, sf_dir), payload_current(spark, sf_dir))


# ---------------------------------------------------------------- views
def q_hourly_24h(spark, sf_dir, by="event"):
    """Next 24 hours from the current hour."""
    return views.hourly_table(views.next_hours(fx.hourly(spark, sf_dir, by), UTC_CLOCK))


def q_hourly_24h_local(spark, sf_dir):
    """W9 by each place's own clock."""
    return views.hourly_table(views.next_hours(fx.hourly(spark, sf_dir), UTC_CLOCK, offsets=fx.hourly_offsets(spark, sf_dir)))


def q_ten_day_local(spark, sf_dir):
    """W10 by each place's own date: at this instant some places are a day ahead."""
    return views.ten_days(payload_daily(spark, sf_dir), LATE_CLOCK, offsets=fx.utc_offsets(spark, sf_dir))


def q_today_range_local(spark, sf_dir):
    """W11 by each place's own date."""
    return views.today_range(payload_daily(spark, sf_dir), LATE_CLOCK, offsets=fx.utc_offsets(spark, sf_dir))


def q_context_series_as_of(spark, sf_dir):
    """W12 with the cut-off option (Q11)."""
    fc = stand_in_forecasts(spark, sf_dir).where(F.col("model") == "persistence")
    return views.context_series(payload_daily(spark, sf_dir), fc, as_of=AS_OF)


def q_ten_day(spark, sf_dir):
    """W10, F7."""
    return views.ten_days(payload_daily(spark, sf_dir), AS_OF)


def q_today_range(spark, sf_dir):
    """W11."""
    return views.today_range(payload_daily(spark, sf_dir), AS_OF)


def q_context_series(spark, sf_dir):
    """Recent actuals, the forecast point and the link segment."""
    fc = stand_in_forecasts(spark, sf_dir).where(F.col("model") == "persistence")
    return views.context_series(payload_daily(spark, sf_dir), fc)


def q_history_range(spark, sf_dir):
    """P5, A6."""
    return views.range_summary(views.history_range(fx.raw_daily(spark, sf_dir), HISTORY_START, HISTORY_END))


def q_history_long(spark, sf_dir):
    """Temperature parameter in long form over the chosen range."""
    rows = views.history_range(fx.raw_daily(spark, sf_dir), HISTORY_START, HISTORY_END)
    return views.history_long(rows, "Temperature (°C)")


def q_hourly_from_daily(spark, sf_dir):
    """every daily row disaggregated into 24 hourly rows."""
    return hourly_from_daily(fx.raw_daily(spark, sf_dir))


def q_place_label(spark, sf_dir):
    """F9, F10."""
    p = fx.nation_places(spark, sf_dir)
    return p.select("location_id",
                    places.place_label(F.col("name"), F.col("admin1"), F.col("admin2"), F.col("country"))
                    .alias("location"),
                    timefmt.coordinates(F.col("latitude"), F.col("longitude")).alias("coordinates"))


def q_local_time(spark, sf_dir):
    """local clock from the payload's UTC offset (default +05:30)."""
    p = fx.forecast_payloads(spark, sf_dir, AS_OF)
    local = timefmt.local_time(F.lit(UTC_CLOCK).cast("timestamp_ntz"), F.col("utc_offset_seconds"))
    return p.select("location_id", "utc_offset_seconds", local.alias("local_time")).withColumn(
        "clock", timefmt.clock_label(F.col("local_time")))


# ---------------------------------------------------------------- metrics
def q_model_metrics(spark, sf_dir, by="region"):
    """A1-A3, U1."""
    return metrics.metrics(fixture_predictions(spark, sf_dir, by))


def q_best_model(spark, sf_dir, by="region"):
    """A4."""
    return metrics.best_model(metrics.metrics(fixture_predictions(spark, sf_dir, by)))


def q_last_120(spark, sf_dir):
    """J3, W13."""
    return metrics.last_days(metrics.aligned(fixture_predictions(spark, sf_dir), "persistence", "midpoint"))


def q_metrics_csv(spark, sf_dir):
    """Metrics through the CSV sink and typed scan."""
    path = scratch_path(spark, "metrics-csv")
    files.write_metrics_csv(q_model_metrics(spark, sf_dir), path)
    return files.read_metrics_csv(spark, path)


def stored_rows(spark, sf_dir) -> DataFrame:
    """What is stored up to the as-of day."""
    return forecast.up_to(fx.raw_daily(spark, sf_dir), AS_OF)


def live_keys(spark, sf_dir) -> DataFrame:
    return payload_daily(spark, sf_dir).select("location_id").distinct().where(fx.live_feed_ok(F.col("location_id")))


def q_cached_current(spark, sf_dir):
    """Current blocks of places without a feed."""
    return payload.cached_current(stored_rows(spark, sf_dir), live_keys(spark, sf_dir))


def q_cached_hourly(spark, sf_dir):
    """Hourly blocks of places without a feed."""
    return payload.cached_hourly(stored_rows(spark, sf_dir), live_keys(spark, sf_dir))


def q_export_with_fallback(spark, sf_dir):
    """Places without a feed are forecast and exported from storage; each place once."""
    ok = fx.live_feed_ok(F.col("location_id"))
    rows = payload.cached_payload_rows(stored_rows(spark, sf_dir), payload_daily(spark, sf_dir).where(ok))
    current = payload_current(spark, sf_dir).where(ok).unionByName(q_cached_current(spark, sf_dir))
    locs = fx.locations(spark, sf_dir)
    best = metrics.best_model(metrics.metrics(fixture_predictions(spark, sf_dir)))
    made = stand_in_forecasts(spark, sf_dir, rows.drop("weather_code", "source"))
    chosen = forecast.choose_forecast(made, files.best_model_for(locs, best))
    return forecast.export_rows(chosen, current, locs, EXPORT_STAMP)


def q_forecast_rejects(spark, sf_dir):
    """With a registry of only the places before "M", the others fall to the default
    model, which made no forecast here: each place is chosen or rejected."""
    registry = metrics.best_model(metrics.metrics(fixture_predictions(spark, sf_dir)))
    best = files.best_model_for(fx.locations(spark, sf_dir), registry.where(fx.live_feed_ok(F.col("location_id"))))
    made = stand_in_forecasts(spark, sf_dir)
    chosen = forecast.choose_forecast(made, best).select("location_id", "model", F.lit("chosen").alias("reason"))
    return chosen.unionByName(forecast.forecast_rejects(made, best))


def q_forecast_export(spark, sf_dir):
    """Best model's forecast + current obs + place -> alert document."""
    best = metrics.best_model(metrics.metrics(fixture_predictions(spark, sf_dir)))
    reg_path = scratch_path(spark, "best-model")
    best.write.mode("overwrite").parquet(reg_path)
    locs = fx.locations(spark, sf_dir)
    chosen_model = files.best_model_for(locs, spark.read.parquet(reg_path))
    chosen = forecast.choose_forecast(stand_in_forecasts(spark, sf_dir), chosen_model)
    doc = forecast.export_rows(chosen, payload_current(spark, sf_dir), locs, EXPORT_STAMP)
    out = scratch_path(spark, "forecast-export")
    files.write_export(doc, out)
    return files.read_export(spark, out)


QUERIES = {
    "raw_daily": q_raw_daily,
    "archive_ingest": q_archive_ingest,
    "csv_ingest": q_csv_ingest,
    "cached_current": q_cached_current,
    "cached_hourly": q_cached_hourly,
    "export_with_fallback": q_export_with_fallback,
    "hourly_24h_local": q_hourly_24h_local,
    "ten_day_local": q_ten_day_local,
    "today_range_local": q_today_range_local,
    "context_series_as_of": q_context_series_as_of,
    "sequence_rejects": q_sequence_rejects,
    "forecast_rejects": q_forecast_rejects,
    "archive_rejects": q_archive_rejects,
    "history_window": q_history_window,
    "payload_daily": q_payload_daily,
    "current_obs": q_current_obs,
    "cached_payload": q_cached_payload,
    "payload_hourly": q_payload_hourly,
    "processed_roundtrip": q_processed_roundtrip,
    "active_coordinates": q_active_coordinates,
    "features_full": q_features_full,
    "lag_features": q_lag_features,
    "rolling_means": q_rolling_means,
    "seasonal": q_seasonal,
    "row_loss": q_row_loss,
    "chrono_split": q_chrono_split,
    "split_summary": q_split_summary,
    "minmax_stats": q_minmax_stats,
    "scaled_features": q_scaled_features,
    "sequence_ends": q_sequence_ends,
    "latest_complete": q_latest_complete,
    "latest_sequence": q_latest_sequence,
    "alerts": q_alerts,
    "alert_rows": q_alert_rows,
    "air_quality": q_air_quality,
    "conditions": q_conditions,
    "tomorrow_condition": q_tomorrow_condition,
    "hourly_24h": q_hourly_24h,
    "ten_day": q_ten_day,
    "today_range": q_today_range,
    "context_series": q_context_series,
    "history_range": q_history_range,
    "history_long": q_history_long,
    "hourly_from_daily": q_hourly_from_daily,
    "place_label": q_place_label,
    "local_time": q_local_time,
    "model_metrics": q_model_metrics,
    "best_model": q_best_model,
    "last_120": q_last_120,
    "metrics_csv": q_metrics_csv,
    "forecast_export": q_forecast_export,
}

# ---------------------------------------------------------------- oracles
_RAW = O.RAW_COLS
_ALERT_CASE = """case
  when {t} >= 37 or ({t} >= 34 and {h} >= 70) then {{sev}}
  when {t} >= 33 then {{heat}}
  when {t} <= 10 then {{cold}}
  when {p} < 1008 and {r} > 5 then {{pres}}
  else {{norm}} end"""


def _alert_sql(t, h, p, r, field):
    from stratus import schemas as S
    specs = {"sev": S.ALERT_SEVERE_HEAT, "heat": S.ALERT_HEAT, "cold": S.ALERT_COLD,
             "pres": S.ALERT_PRESSURE, "norm": S.ALERT_NORMAL}
    idx = {"level": 0, "risk": 1, "guideline": 2}[field]

    def lit(v):
        return f"{v}" if isinstance(v, float) else "'" + str(v).replace("'", "''") + "'"
    return _ALERT_CASE.format(t=t, h=h, p=p, r=r).format(**{k: lit(v[idx]) for k, v in specs.items()})


_ALERTED = f"""(select location_id, date, wind_speed,
  {_alert_sql('temp_mean', 'humidity', 'pressure', 'precipitation', 'level')} as lvl from daily)"""

_SEQ_CTE = f"""(select *,
  first_value(temp_mean_s) over ({O.W} rows between {SEQ_LEN - 1} preceding and current row) as first_temp_mean_s,
  first_value(pressure_s) over ({O.W} rows between {SEQ_LEN - 1} preceding and current row) as first_pressure_s,
  cast(count(*) over ({O.W} rows between {SEQ_LEN - 1} preceding and current row) as integer) as seq_rows
  from scaled)"""

_LAST_SEQ = f"""(select * from (select *, row_number() over (partition by location_id order by date desc) as rb
  from (select {_RAW}, {O._seasonal()} from daily where date <= {O.AS_OF})
  where {O.not_null(SEQUENCE_FEATURES)}) where rb <= {SEQ_LEN})"""

_POS = f"""(select *, cast(row_number() over ({O.W}) as integer) as rn,
  count(*) over (partition by location_id) as n,
  min(case when date = {O.AS_OF} then rn0 end) over (partition by location_id) as today_rn
  from (select *, cast(row_number() over ({O.W}) as integer) as rn0 from payload_rows))"""

_FORECASTS = """(select location_id, latest_obs_date, forecast_date, 'persistence' as model, temp_mean as forecast_temp
  from latest union all
  select location_id, latest_obs_date, forecast_date, 'midpoint' as model, (temp_max + temp_mean_lag_1) / 2
  from latest)"""

_RANKED_PAYLOAD = """(select *, row_number() over (partition by location_id order by date desc) as rb
  from payload_rows)"""

_CURRENT_SQL = ["temp_mean as temperature_2m", "humidity as relative_humidity_2m", "precipitation",
                "pressure as pressure_msl", "wind_speed as wind_speed_10m"]
_LATE_DATE = (f"cast(timestamp '{LATE_CLOCK}' + to_seconds(coalesce((select utc_offset_seconds from offsets o"
              " where o.location_id = payload_rows_.location_id), 19800)) as date)")
_POS_LOCAL = f"""(select *, cast(row_number() over ({O.W}) as integer) as rn,
  count(*) over (partition by location_id) as n,
  min(case when date = here then rn0 end) over (partition by location_id) as today_rn
  from (select *, {_LATE_DATE} as here, cast(row_number() over ({O.W}) as integer) as rn0
        from payload_rows as payload_rows_))"""

_PLACE_LABEL = """concat_ws(', ', name,
  case when admin2 is not null and admin2 <> '' and admin2 <> name then admin2 end,
  case when admin1 is not null and admin1 <> '' and admin1 is distinct from admin2 and admin1 <> name then admin1 end,
  case when country is not null and country <> '' then country end)"""

ORACLES = {
    "raw_daily": O.sql("select * from raw"),
    "archive_ingest": O.sql("select * from raw"),
    "csv_ingest": O.sql(f"""select location_id, date, {', '.join(c for c in RAW_ORDER if c != 'pressure')},
        case when day(date) = 13 then null else pressure end as pressure from raw"""),
    "sequence_rejects": O.sql(f"""select location_id, max(n) as rows, case when max(split_at) < 1 then 'no training row'
        else 'fewer complete rows than the sequence length' end as reason
        from split group by location_id having max(split_at) < 1 or max(n) < {LONG_SEQ_LEN}""", daily=fx.SUPPLIER_DAILY_SQL),
    "forecast_rejects": O.sql("""select l.location_id,
        case when l.location_id < 'M' then b.model else 'Random Forest' end as model,
        case when l.location_id < 'M' then 'chosen' else 'no forecast by the best model' end as reason
        from locs l left join best b on b.location_id = l.location_id"""),
    "archive_rejects": O.sql("select distinct location_id, 'no daily block' as reason from daily"),
    "history_window": O.sql(f"select * from raw where date between {O.AS_OF} - {HISTORY_DAYS + HISTORY_DELAY_DAYS}"
                            f" and {O.AS_OF} - {HISTORY_DELAY_DAYS}"),
    "payload_daily": O.sql(f"select location_id, date, {', '.join(RAW_ORDER)}, weather_code from payload_rows"),
    "current_obs": O.sql("select * from current_obs"),
    "cached_payload": O.sql(f"""
        select location_id, date, {', '.join(RAW_ORDER)}, weather_code, 'live' as source
        from payload_rows where location_id < 'M'
        union all
        select location_id, date, {', '.join(RAW_ORDER)}, 0 as weather_code, 'cached' as source from (
          select *, row_number() over (partition by location_id order by date desc) as rb,
                 count(*) over (partition by location_id) as cnt
          from raw where location_id not in (select location_id from payload_rows where location_id < 'M'))
        where rb <= 41 and least(cnt, 41) >= 30"""),
    "features_full": O.sql("select * from processed"),
    "payload_hourly": O.sql("select * from hourly"),
    "processed_roundtrip": O.sql("select * from processed"),
    "active_coordinates": O.sql("""select p.location_id,
        case when n.n_nationkey % 7 = 0 then 'Mumbai, India' else p.name end as location,
        case when n.n_nationkey % 5 < 3 then 19.076 else p.latitude end as latitude,
        case when n.n_nationkey % 5 < 3 then 72.8777 else p.longitude end as longitude
        from places p join nation n on n.n_name = p.location_id"""),
    "lag_features": O.sql("select location_id, date, " + ", ".join(LAG_COLUMNS)
                          + " from (" + O.feature_select("raw") + ")"),
    "rolling_means": O.sql("select location_id, date, " + ", ".join(ROLL_MEAN_COLUMNS)
                           + " from (" + O.feature_select("raw") + ")"),
    "seasonal": O.sql("select location_id, date, " + ", ".join(SEASONAL) + " from (" + O.feature_select("raw") + ")"),
    "row_loss": O.sql(f"""select location_id, count(*) as rows_in,
        count(*) filter (where not ({O.not_null(O.ALL_FEATURE_COLS)})) as rows_dropped,
        count(*) filter (where {O.not_null(O.ALL_FEATURE_COLS)}) as rows_kept from feat group by location_id"""),
    "chrono_split": O.sql("select location_id, date, rn, n, split_at, split from split"),
    "split_summary": O.sql("""select location_id, split, count(*) as rows, min(date) as first_date,
        max(date) as last_date from split group by location_id, split"""),
    "minmax_stats": O.sql("select * from stats"),
    "scaled_features": O.sql("select location_id, date, split, "
                             + ", ".join(f"{c}_s" for c in O.SCALE_COLS) + " from scaled"),
    "sequence_ends": O.sql(f"""select location_id, date, rn,
        case when rn <= split_at then 'train' else 'test' end as seq_split, seq_rows,
        first_temp_mean_s, temp_mean_s as last_temp_mean_s, first_pressure_s, cos_day_s as last_cos_day_s,
        target_temp_s, target_temp from {_SEQ_CTE} where rn >= {SEQ_LEN}"""),
    "latest_complete": O.sql("select location_id, latest_obs_date, forecast_date, "
                             + ", ".join(TABULAR_FEATURES) + " from latest"),
    "latest_sequence": O.sql(f"""select location_id, count(*) as seq_rows, min(date) as seq_start,
        max(date) as seq_end, arg_min(temp_mean, date) as first_temp_mean, arg_max(temp_mean, date) as last_temp_mean,
        arg_max(cos_day, date) as last_cos_day from {_LAST_SEQ} group by location_id having count(*) = {SEQ_LEN}"""),
    "alerts": O.sql(f"""select location_id, date,
        {_alert_sql('temp_mean', 'humidity', 'pressure', 'precipitation', 'level')} as alert_level,
        {_alert_sql('temp_mean', 'humidity', 'pressure', 'precipitation', 'risk')} as risk_pct,
        {_alert_sql('temp_mean', 'humidity', 'pressure', 'precipitation', 'guideline')} as guideline
        from daily"""),
    "alert_rows": O.sql(f"""select location_id, date, lvl as alert_title,
          case when regexp_matches(lvl, 'SEVERE|WARNING') then '#ef4444' else '#eab308' end as alert_colour
          from {_ALERTED} a where lvl <> 'NORMAL'
        union all
        select location_id, date, 'High Wind Caution', '#eab308' from {_ALERTED} a where wind_speed > 20
        union all
        select location_id, date, 'Atmospheric All Clear', '#10b981' from {_ALERTED} a
          where lvl = 'NORMAL' and not (wind_speed > 20)"""),
    "air_quality": O.sql("""select location_id, date,
        case when humidity > 80 then 'Moderate' else 'Good' end as air_quality from daily"""),
    "conditions": O.sql("""select location_id, date, weather_code, coalesce(wmo_label, 'Unknown') as condition
        from daily left join wmo on weather_code = wmo_code"""),
    "tomorrow_condition": O.sql("""select l.location_id, l.forecast_date,
        case when p.date is not null and l.location_id <> 'ASIA' then coalesce(w.wmo_label, 'Unknown')
             when c.precipitation > 5 then 'Rainy / Wet'
             when c.wind_speed_10m > 20 then 'Windy'
             when c.relative_humidity_2m > 80 then 'Humid'
             else 'Partly Cloudy' end as condition
        from latest l left join payload_rows p on p.location_id = l.location_id and p.date = l.forecast_date
        left join current_obs c on c.location_id = l.location_id
        left join wmo w on p.weather_code = w.wmo_code"""),
    "hourly_24h": O.sql(f"""select location_id, ts, strftime(ts, '%I:00 %p') as hour,
        coalesce(wmo_icon, '❓') as icon, coalesce(wmo_label, 'Unknown') as condition,
        printf('%.1f°C', temperature_2m) as temperature, printf('%.0f%%', relative_humidity_2m) as humidity,
        printf('%.1f km/h', wind_speed_10m) as wind_speed, printf('%d%%', precipitation_probability) as rain_prob
        from (select *, row_number() over (partition by location_id order by ts) as rn from (
          select h.*, coalesce(min(case when ts = date_trunc('hour', timestamp '{UTC_CLOCK}') then ts end)
                   over (partition by location_id), min(ts) over (partition by location_id)) as st
          from hourly h) where ts >= st) q
        left join wmo on weather_code = wmo_code where rn <= 24"""),
    "ten_day": O.sql(f"""select location_id, date, strftime(date, '%A, %b %d') as day, temp_max, temp_min,
        coalesce(wmo_icon, '❓') as icon, coalesce(wmo_label, 'Unknown') as condition
        from {_POS} p left join wmo on weather_code = wmo_code
        where rn >= coalesce(today_rn, greatest(1, n - 9)) and rn < coalesce(today_rn, greatest(1, n - 9)) + 10"""),
    "today_range": O.sql(f"""select location_id, date, temp_max as today_max, temp_min as today_min,
        today_rn is not null as matched_today from {_POS}
        where rn = coalesce(today_rn, case when n >= 10 then n - 9 else 1 end)"""),
    "context_series": O.sql(f"""
        select location_id, date, temp_mean as value, 'actual' as kind from {_RANKED_PAYLOAD} r where rb between 2 and 15
        union all select location_id, date, temp_mean, 'link' from {_RANKED_PAYLOAD} r where rb = 2
        union all select location_id, forecast_date, forecast_temp, 'forecast' from {_FORECASTS} f
          where model = 'persistence'
        union all select location_id, forecast_date, forecast_temp, 'link' from {_FORECASTS} f
          where model = 'persistence' and location_id in (select location_id from {_RANKED_PAYLOAD} r where rb = 2)"""),
    "history_range": O.sql(f"""select location_id, min(date) as first_date, max(date) as last_date, count(*) as days
        from raw where date between date '{HISTORY_START}' and date '{HISTORY_END}' group by location_id"""),
    "history_long": O.sql(f"""unpivot (select location_id, date, temp_max, temp_mean, temp_min from raw
        where date between date '{HISTORY_START}' and date '{HISTORY_END}')
        on temp_max, temp_mean, temp_min into name series value value"""),
    "hourly_from_daily": O.sql("""select location_id, cast(date as timestamp) + to_hours(h) as ts,
        round(temp_mean + sin((h - 6) * pi() / 12.0) * ((temp_max - temp_min) / 2.0), 9) as temperature_2m,
        humidity as relative_humidity_2m, case when precipitation > 0 then 20 else 0 end as precipitation_probability,
        wind_speed as wind_speed_10m, pressure as pressure_msl, 0 as weather_code
        from raw, (select cast(range as integer) as h from range(24)) hours"""),
    "place_label": O.sql(f"""select location_id, {_PLACE_LABEL} as location,
        cast(latitude as varchar) || ',' || cast(longitude as varchar) as coordinates from places"""),
    "local_time": O.sql(f"""select location_id, utc_offset_seconds,
        timestamp '{UTC_CLOCK}' + to_seconds(coalesce(utc_offset_seconds, 19800)) as local_time,
        strftime(timestamp '{UTC_CLOCK}' + to_seconds(coalesce(utc_offset_seconds, 19800)),
                 '%b %d, %Y | %I:%M %p') as clock
        from offsets where location_id in (select location_id from payload_rows)"""),
    "model_metrics": O.sql("select * from model_metrics"),
    "best_model": O.sql("select * from best"),
    "last_120": O.sql("""select location_id, date, actual, baseline_pred, sequence_pred from (
        select a.location_id, a.date, a.actual, a.predicted as baseline_pred, b.predicted as sequence_pred,
          row_number() over (partition by a.location_id order by a.date desc) as rb
        from predictions a join predictions b on a.location_id = b.location_id and a.date = b.date
        where a.model = 'persistence' and b.model = 'midpoint') where rb <= 120"""),
    "metrics_csv": O.sql("select location_id, model, rmse, mae from model_metrics"),
    "forecast_export": O.sql(f"""select f.location_id,
        {_PLACE_LABEL.replace('name', 'l.name')} as location,
        cast(l.latitude as varchar) || ',' || cast(l.longitude as varchar) as coordinates,
        c.temperature_2m as temp_today, f.forecast_temp as temp_tomorrow, c.relative_humidity_2m as humidity,
        c.wind_speed_10m as wind_speed, c.pressure_msl as pressure, c.precipitation, f.model as model_used,
        {_alert_sql('f.forecast_temp', 'c.relative_humidity_2m', 'c.pressure_msl', 'c.precipitation', 'level')}
          as biometeorological_alert,
        {_alert_sql('f.forecast_temp', 'c.relative_humidity_2m', 'c.pressure_msl', 'c.precipitation', 'risk')}
          as risk_penalty_percentage,
        {_alert_sql('f.forecast_temp', 'c.relative_humidity_2m', 'c.pressure_msl', 'c.precipitation', 'guideline')}
          as health_guidelines,
        '{EXPORT_STAMP}' as timestamp
        from {_FORECASTS} f
        join locs l on l.location_id = f.location_id
        join (select l2.location_id, coalesce(b.model, 'Random Forest') as model from locs l2
              left join best b on b.location_id = l2.location_id) bm
          on bm.location_id = f.location_id and bm.model = f.model
        left join current_obs c on c.location_id = f.location_id"""),
}


def _swap(base: str, old: str, new: str) -> str:
    """An oracle with one part replaced."""
    assert old in ORACLES[base], (base, old)
    return ORACLES[base].replace(old, new)


ORACLES.update({
    "cached_current": O.sql(f"""select location_id, {', '.join(_CURRENT_SQL)} from (
        select *, row_number() over (partition by location_id order by date desc) as rb
        from raw_asof where location_id >= 'M') where rb = 1"""),
    "cached_hourly": _swap("hourly_from_daily", "from raw, (select", f"""from (select * from (
        select *, row_number() over (partition by location_id order by date desc) as rb
        from raw_asof where location_id >= 'M') where rb <= 41), (select"""),
    "export_with_fallback": ORACLES["forecast_export"],
    "hourly_24h_local": _swap("hourly_24h", f"date_trunc('hour', timestamp '{UTC_CLOCK}')",
        f"date_trunc('hour', timestamp '{UTC_CLOCK}' + to_seconds(case when location_id >= 'd'"
        " then (ascii(location_id) % 7 - 3) * 3600 else 19800 end))"),
    "ten_day_local": _swap("ten_day", _POS, _POS_LOCAL),
    "today_range_local": _swap("today_range", _POS, _POS_LOCAL),
    "context_series_as_of": _swap("context_series", _RANKED_PAYLOAD, _RANKED_PAYLOAD.replace(
        "from payload_rows)", f"from payload_rows where date <= {O.AS_OF})")),
})


# ---------------------------------------------------------------- places that grow with the data
def _family(base: str, **views: str) -> str:
    """An oracle of the region family over another family of places."""
    text = ORACLES[base]
    for name, new in views.items():
        old = f"{name} as ({O.CTES[name]})"
        assert old in text
        text = text.replace(old, f"{name} as ({new})")
    return text


def _by(plan, by):
    def run(spark, sf_dir):
        return plan(spark, sf_dir, by=by)
    run.__doc__ = f"{plan.__doc__} One place per {by}."
    return run


for _name, _plan in {"features": q_features_full, "row_loss": q_row_loss, "chrono_split": q_chrono_split,
                     "scaled_features": q_scaled_features, "sequence_ends": q_sequence_ends,
                     "latest_complete": q_latest_complete, "latest_sequence": q_latest_sequence, "alerts": q_alerts,
                     "model_metrics": q_model_metrics, "best_model": q_best_model}.items():
    QUERIES[f"supplier_{_name}"] = _by(_plan, "supplier")
    ORACLES[f"supplier_{_name}"] = _family({"features": "features_full"}.get(_name, _name), daily=fx.SUPPLIER_DAILY_SQL)
QUERIES["user_hourly_24h"] = _by(q_hourly_24h, "user")
ORACLES["user_hourly_24h"] = _family("hourly_24h", hourly=fx.USER_HOURLY_SQL)


# ---------------------------------------------------------------- model plans (rows-only checks)
_FITTED: dict[tuple, object] = {}


def _cached_fit(spark, key: tuple, fit):
    """Fit once per (session, inputs); later queries of the session reuse it."""
    full = (spark.sparkContext.applicationId,) + key
    if full not in _FITTED:
        _FITTED[full] = fit()
    return _FITTED[full]


def forest_model(spark, sf_dir):
    from stratus.plans import models as M
    return _cached_fit(spark, ("forest", sf_dir),
                       lambda: M.fit_forest(split_processed(spark, sf_dir)))


def sequence_model(spark, sf_dir, kind: str = "linear"):
    from stratus.plans import models as M

    def fit():
        data, stats = M.sequence_dataset(processed(spark, sf_dir), SEQ_LEN)
        return M.fit_sequence(data, kind), stats
    return _cached_fit(spark, ("sequence", kind, sf_dir), fit)


def q_rf_fit_score(spark, sf_dir):
    """M1, M2, A1-A3: pooled forest, test-split metrics per location."""
    from stratus.plans import models as M
    return metrics.metrics(M.score_forest(forest_model(spark, sf_dir), split_processed(spark, sf_dir)))


def q_feature_importance(spark, sf_dir):
    """M3, K1: top 15 forest feature importances."""
    from stratus.plans import models as M
    return metrics.top_importances(M.importances(spark, forest_model(spark, sf_dir)))


def q_seq_fit_score(spark, sf_dir):
    """M6, M7, M5: sequence regressor on 7-day windows, test metrics per location."""
    from stratus.plans import models as M
    model, _ = sequence_model(spark, sf_dir)
    data, _ = M.sequence_dataset(processed(spark, sf_dir), SEQ_LEN)
    return metrics.metrics(M.score_sequence(model, data, M.sequence_name("linear")))


def q_seq_gbt_fit_score(spark, sf_dir):
    """M6, M7 (gradient-boosted variant): test metrics per location."""
    from stratus.plans import models as M
    model, _ = sequence_model(spark, sf_dir, "gbt")
    data, _ = M.sequence_dataset(processed(spark, sf_dir), SEQ_LEN)
    return metrics.metrics(M.score_sequence(model, data, M.sequence_name("gbt")))


def q_rf_forecast(spark, sf_dir):
    """M8: next-day forecast from the latest complete row up to as_of."""
    from stratus.plans import models as M
    return M.forecast_forest(forest_model(spark, sf_dir), payload_rows(spark, sf_dir), AS_OF)


def q_seq_forecast(spark, sf_dir):
    """M9: next-day forecast from the last 7 complete rows up to as_of."""
    from stratus.plans import models as M
    model, stats = sequence_model(spark, sf_dir)
    out, _ = M.forecast_sequence(model, stats, payload_rows(spark, sf_dir), AS_OF, M.sequence_name("linear"))
    return out


def q_tuning(spark, sf_dir):
    """Window length x regularisation grid on the chronological split."""
    from stratus.plans import models as M
    return M.tune_sequence(processed(spark, sf_dir), seq_lens=(3, 7, 14))


def q_tuning_from_sums(spark, sf_dir):
    """Five strengths per window length from one aggregate of each."""
    from stratus.plans import models as M
    return M.tune_linear(processed(spark, sf_dir))


def real_predictions(spark, sf_dir) -> DataFrame:
    """Test-split predictions of the fitted forest and linear sequence model (long rows)."""
    from stratus.plans import models as M
    model, _ = sequence_model(spark, sf_dir)
    data, _ = M.sequence_dataset(processed(spark, sf_dir), SEQ_LEN)
    return (M.score_forest(forest_model(spark, sf_dir), split_processed(spark, sf_dir))
            .unionByName(M.score_sequence(model, data, M.sequence_name("linear"))))


def q_model_comparison(spark, sf_dir):
    """Both real models' metrics and the chosen best model."""
    table = metrics.metrics(real_predictions(spark, sf_dir))
    best = metrics.best_model(table).select("location_id", F.col("model").alias("best_model"))
    return table.join(best, "location_id")


def q_training_pipeline(spark, sf_dir):
    """T1 + M11 + M12: features -> both fits -> persisted models -> evaluation job."""
    from stratus.plans import jobs
    result = jobs.train(spark, fx.raw_daily(spark, sf_dir))
    return result.outputs["metrics"].join(
        result.outputs["best_model"].select("location_id", F.col("model").alias("best_model")), "location_id")


def q_live_export(spark, sf_dir):
    """Live-forecast lifecycle with the real models: M8 + M9 forecasts, best
    model by test RMSE (A4, J5), current observation and place (J4), alert
    cascade (P8), written as the JSON document (S10) and read back."""
    from stratus.plans import models as M
    raw = payload_rows(spark, sf_dir)
    forest = forest_model(spark, sf_dir)
    seq_model, stats = sequence_model(spark, sf_dir)
    seq_name = M.sequence_name("linear")
    seq_fc, _ = M.forecast_sequence(seq_model, stats, raw, AS_OF, seq_name)
    forecasts = M.forecast_forest(forest, raw, AS_OF).unionByName(seq_fc)
    best = metrics.best_model(metrics.metrics(real_predictions(spark, sf_dir)))
    locs = fx.locations(spark, sf_dir)
    chosen = forecast.choose_forecast(forecasts, files.best_model_for(locs, best))
    doc = forecast.export_rows(chosen, payload_current(spark, sf_dir), locs, EXPORT_STAMP)
    out = scratch_path(spark, "live-export")
    files.write_export(doc, out)
    return files.read_export(spark, out)


def q_retrain_places(spark, sf_dir):
    """Retrain for the places whose baseline lost (the sequence model had
    the lower test RMSE), then record them as the active places."""
    from stratus.plans import jobs
    table = metrics.metrics(real_predictions(spark, sf_dir))
    chosen = (metrics.best_model(table).where(F.col("model") != "Random Forest")
              .join(fx.locations(spark, sf_dir), "location_id"))
    try:
        result = jobs.retrain_locations(spark, fx.raw_daily(spark, sf_dir), chosen)
    except jobs.PipelineStageError:      # no place to retrain
        return table.limit(0)
    return result.outputs["metrics"]


def q_scored_rows(spark, sf_dir):
    """M2, M7: what the fitted models scored, per place and model."""
    finite = F.count_if(F.col("predicted").isNotNull() & ~F.isnan("predicted") & (F.abs("predicted") < 1e6))
    return real_predictions(spark, sf_dir).groupBy("location_id", "model").agg(
        F.count(F.lit(1)).alias("rows"), finite.alias("finite"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"), F.round(F.sum("actual"), 4).alias("actual_sum"))


def q_forecast_dates(spark, sf_dir):
    """M8, M9: which day each model saw last and which it forecasts."""
    rows = q_rf_forecast(spark, sf_dir).unionByName(q_seq_forecast(spark, sf_dir))
    return rows.select("location_id", "model", "latest_obs_date", "forecast_date",
                       (F.abs("forecast_temp") < 1e6).alias("finite"))


def q_scaler_inverse(spark, sf_dir):
    """M4, M5: the inverse of the scaled target is the target."""
    back = scaling.unscale(F.col(f"{TARGET}_s"), F.col(f"{TARGET}_min"), F.col(f"{TARGET}_max"))
    return scaled_processed(spark, sf_dir).groupBy("location_id").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum(back), 4).alias("target_sum"))


def q_model_reload(spark, sf_dir):
    """A stored and reloaded forest predicts what the fitted one does."""
    from stratus.plans import models as M
    model, path = forest_model(spark, sf_dir), scratch_path(spark, "forest-copy")
    M.save_pipeline(model, path)
    rows = split_processed(spark, sf_dir)
    a = M.score_forest(model, rows).select("location_id", "date", F.col("predicted").alias("a"))
    b = M.score_forest(M.load_pipeline(path), rows).select("location_id", "date", F.col("predicted").alias("b"))
    return a.join(b, ["location_id", "date"]).groupBy("location_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("a") == F.col("b")).alias("equal"))


def q_sequence_residuals(spark, sf_dir):
    """M6: the intercept fit's training residuals sum to zero."""
    from stratus.plans import models as M
    model, _ = sequence_model(spark, sf_dir)
    data, _ = M.sequence_dataset(processed(spark, sf_dir), SEQ_LEN)
    out = model.transform(data.where(F.col("seq_split") == "train"))
    residual = F.col("predicted_s") - F.col(f"{TARGET}_s")
    return out.agg(F.count(F.lit(1)).alias("rows"), (F.abs(F.avg(residual)) < 1e-6).alias("centred"))


def q_importance_summary(spark, sf_dir):
    """M3, K1: importances over the 40 features sum to one; the top 15 come in order."""
    from stratus.plans import models as M
    every = M.importances(spark, forest_model(spark, sf_dir))
    top = metrics.top_importances(every)
    return every.agg(F.countDistinct("feature").alias("features"), F.round(F.sum("importance"), 6).alias("total"),
                     (F.min("importance") >= 0).alias("nonnegative")).withColumn("top", F.lit(top.count()).cast("long"))


def q_forest_vs_persistence(spark, sf_dir):
    """M1, A1: the forest beats the persistence stand-in on every place."""
    from stratus.plans import models as M
    forest = metrics.metrics(M.score_forest(forest_model(spark, sf_dir), split_processed(spark, sf_dir)))
    base = metrics.metrics(fixture_predictions(spark, sf_dir)).where(F.col("model") == "persistence")
    return base.select("location_id", F.round("rmse", 6).alias("persistence_rmse")).join(
        forest.select("location_id", F.col("rmse").alias("forest")), "location_id").select(
        "location_id", "persistence_rmse", (F.col("forest") < F.col("persistence_rmse")).alias("forest_beats"))


def q_stored_metrics(spark, sf_dir):
    """Metrics stored by the training job equal those of its stored predictions."""
    from stratus.plans import jobs
    from stratus.plans import models as M
    result = jobs.train(spark, fx.raw_daily(spark, sf_dir), forest=M.ForestParams(num_trees=10, max_depth=6))
    stored = files.read_metrics_csv(spark, f"{result.root}/metrics_csv")
    again = metrics.metrics(spark.read.parquet(f"{result.root}/predictions"))
    both = stored.join(again.select("location_id", "model", "n", F.col("rmse").alias("r"), F.col("mae").alias("m")),
                       ["location_id", "model"])
    return both.select("location_id", "model", F.col("n").alias("rows"),
                       ((F.abs(F.col("rmse") - F.col("r")) < 1e-9) & (F.abs(F.col("mae") - F.col("m")) < 1e-9)).alias("equal"))


QUERIES.update({
    "scored_rows": q_scored_rows,
    "forecast_dates": q_forecast_dates,
    "scaler_inverse": q_scaler_inverse,
    "model_reload": q_model_reload,
    "sequence_residuals": q_sequence_residuals,
    "importance_summary": q_importance_summary,
    "forest_vs_persistence": q_forest_vs_persistence,
    "stored_metrics": q_stored_metrics,
})

_MODELS = "(values ('Random Forest'), ('seq_linear')) as models(model)"
ORACLES.update({
    "scored_rows": O.sql(f"""select location_id, model, count(*) as rows, count(*) as finite, min(date) as first_date,
        max(date) as last_date, round(sum(target_temp), 4) as actual_sum from split, {_MODELS}
        where split = 'test' group by location_id, model"""),
    "forecast_dates": O.sql(f"""select location_id, model, latest_obs_date, forecast_date, true as finite
        from latest, {_MODELS}"""),
    "scaler_inverse": O.sql("select location_id, count(*) as rows, round(sum(target_temp), 4) as target_sum from split group by location_id"),
    "model_reload": O.sql("""select location_id, count(*) as rows, count(*) as equal from split
        where split = 'test' group by location_id"""),
    "sequence_residuals": O.sql(f"""select count(*) as rows, true as centred from split
        where split = 'train' and rn >= {SEQ_LEN}"""),
    "importance_summary": O.sql(f"select cast({len(TABULAR_FEATURES)} as bigint) as features, 1.0::double as total,"
                                " true as nonnegative, cast(15 as bigint) as top"),
    "forest_vs_persistence": O.sql("""select location_id, round(rmse, 6) as persistence_rmse, true as forest_beats
        from model_metrics where model = 'persistence'"""),
    "stored_metrics": O.sql(f"""select location_id, model, count(*) as rows, true as equal from split, {_MODELS}
        where split = 'test' group by location_id, model"""),
})

QUERIES.update({
    "training_pipeline": q_training_pipeline,
    "retrain_places": q_retrain_places,
    "live_export": q_live_export,
    "rf_fit_score": q_rf_fit_score,
    "feature_importance": q_feature_importance,
    "seq_fit_score": q_seq_fit_score,
    "seq_gbt_fit_score": q_seq_gbt_fit_score,
    "rf_forecast": q_rf_forecast,
    "seq_forecast": q_seq_forecast,
    "tuning": q_tuning,
    "tuning_from_sums": q_tuning_from_sums,
    "model_comparison": q_model_comparison,
})


# ---------------------------------------------------------------- streaming plans
def hourly_climatology(spark, sf_dir) -> DataFrame:
    """Static forecast table for the observation stream: each place's mean hourly temperature."""
    return fx.hourly(spark, sf_dir).groupBy("location_id").agg(F.avg("temperature_2m").alias("forecast_temp"))


def q_stream_alerts(spark, sf_dir):
    """Observation files -> ids seen for the first time -> stream-static join -> alerts -> Parquet sink."""
    from stratus.streaming import alerts as stream_alerts
    source, sink, ckpt = (scratch_path(spark, n) for n in ("obs-landing", "obs-alerts", "obs-ckpt"))
    fx.observations(spark, sf_dir).repartitionByRange(4, "ts").write.parquet(source)
    stream_alerts.run(spark, source, hourly_climatology(spark, sf_dir), sink, ckpt)
    # Event time is an instant (TIMESTAMP) in the stream; report it as the
    # wall clock it came in as (TIMESTAMP_NTZ), like every other time column.
    return (stream_alerts.scored_observations(spark, sink).drop("late")
            .withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def q_late_observations(spark, sf_dir):
    """Every fiftieth observation is delivered after all others (and some of the others
    again); none is lost, and those more than the delay behind are listed."""
    from stratus.streaming import alerts as stream_alerts
    source, sink, ckpt = (scratch_path(spark, n) for n in ("obs-landing", "obs-alerts", "obs-ckpt"))
    rows, climate = fx.observations(spark, sf_dir), hourly_climatology(spark, sf_dir)
    held = F.col("event_id") % 50 == 0
    rows.where(~held).write.parquet(source)
    stream_alerts.run(spark, source, climate, sink, ckpt)
    rows.where(held | (F.col("event_id") % 50 == 1)).write.mode("append").parquet(source)
    stream_alerts.run(spark, source, climate, sink, ckpt)
    return (stream_alerts.scored_observations(spark, sink).groupBy("location_id", "late")
            .agg(F.count(F.lit(1)).alias("observations"), F.countDistinct("event_id").alias("events"),
                 F.sum("event_id").alias("id_sum")))


def q_stream_corrections(spark, sf_dir):
    """T4: days that come late and days sent again with a missing pressure; the view equals
    the batch table of the corrected rows, after a compaction too."""
    from stratus.streaming import features as stream_features
    source, root, ckpt = (scratch_path(spark, n) for n in ("daily-landing", "feature-store", "daily-ckpt"))
    raw = fx.raw_daily(spark, sf_dir)
    late, resent = F.dayofmonth("date") == 9, (F.dayofmonth("date") == 20) & (F.month("date") == 6)
    raw.where(~late).write.parquet(source)
    stream_features.run(spark, source, root, ckpt, max_files_per_trigger=None)
    stream_features.compact(spark, root)
    (raw.where(late).unionByName(raw.where(resent).withColumn("pressure", F.lit(None).cast("double")))
     .write.mode("append").parquet(source))
    stream_features.run(spark, source, root, ckpt, max_files_per_trigger=None)
    return stream_features.feature_view(spark, root)


def q_stream_features(spark, sf_dir):
    """T4: daily rows arriving in several files (any order) -> foreachBatch
    feature refresh -> merge-on-read feature store; equals the batch table."""
    from stratus.streaming import features as stream_features
    source, root, ckpt = (scratch_path(spark, n) for n in ("daily-landing", "feature-store", "daily-ckpt"))
    (fx.raw_daily(spark, sf_dir).repartition(4, F.year("date") % 4).write.parquet(source))
    stream_features.run(spark, source, root, ckpt, max_files_per_trigger=1)
    return stream_features.feature_view(spark, root)


# ---------------------------------------------------------------- series of any length
def q_long_features(spark, sf_dir):
    """W1-W3 without a window over a whole series: blocks of 256 rows, so that the test's series have many."""
    from stratus.operators import longseries
    return feat.complete_rows(longseries.with_long_features(fx.raw_daily(spark, sf_dir), block_rows=256))


def q_long_split(spark, sf_dir):
    """W4 from positions: row counts per month and their prefix sums."""
    from stratus.operators import longseries
    return longseries.with_split(processed(spark, sf_dir), bucket="month").select(
        "location_id", "date", F.col("rn").cast("int"), "n", F.col("split_at").cast("int"), "split")


QUERIES.update({"long_features": q_long_features, "long_split": q_long_split})
ORACLES.update({"long_features": ORACLES["features_full"], "long_split": ORACLES["chrono_split"]})


# ---------------------------------------------------------------- incremental landing
def q_landed_raw(spark, sf_dir):
    """Archive documents in three landings, the corrected fetch before the stale one; the raw table
    holds each day once, and a landing without new files reads none."""
    from stratus.streaming import landing
    source, root, ckpt = (scratch_path(spark, n) for n in ("landing", "landed-tables", "landing-ckpt"))
    whole = scratch_path(spark, "all-payloads")
    fx.land_archive_payloads(spark, sf_dir, whole)
    lines = spark.read.text(whole)
    for part in (lines.where("value LIKE '%\"fetched_at\":\"2002%'"), lines.where("value NOT LIKE '%\"fetched_at\":\"2002%'"), None):
        if part is not None:
            part.write.mode("append").text(f"{source}/docs")
        landing.run(spark, source, root, ckpt)
    return landing.table(spark, root, "raw").drop("fetched_at").select("location_id", "date", *RAW_ORDER)


def _refetched(spark, sf_dir, name):
    """Tables after three landings: a wrong fetch, the right one, and a wrong one that is older than both."""
    from stratus.streaming import landing
    source, root, ckpt = (scratch_path(spark, n) for n in ("landing", "landed-tables", "landing-ckpt"))
    for fetch, off in ((1, 50.0), (2, 0.0), (0, 70.0)):
        fx.land_refetched_payloads(spark, sf_dir, source, fetch, off)
        landing.run(spark, source, root, ckpt)
    return landing.table(spark, root, name).drop("fetched_at")


def q_refetched_hourly(spark, sf_dir):
    """One row per place and hour, of the newest fetch."""
    return _refetched(spark, sf_dir, "hourly")


def q_refetched_current(spark, sf_dir):
    """One current observation per place, of the newest fetch."""
    return _refetched(spark, sf_dir, "current").drop("utc_offset_seconds")


def q_bad_records(spark, sf_dir):
    """Per place the days that were ingested, and what was rejected under which reason."""
    from stratus.streaming import landing
    source, root, ckpt = (scratch_path(spark, n) for n in ("landing", "landed-tables", "landing-ckpt"))
    fx.land_broken_payloads(spark, sf_dir, f"{source}/docs")
    landing.run(spark, source, root, ckpt)
    good = landing.table(spark, root, "raw").select("location_id", F.lit("ingested").alias("reason"))
    bad = landing.table(spark, root, "rejects").select("location_id", "reason")
    return good.unionByName(bad).groupBy("location_id", "reason").agg(F.count(F.lit(1)).alias("records"))


QUERIES.update({"landed_raw": q_landed_raw, "refetched_hourly": q_refetched_hourly,
                "refetched_current": q_refetched_current, "bad_records": q_bad_records})
ORACLES.update({
    "landed_raw": ORACLES["archive_ingest"],
    "refetched_hourly": ORACLES["payload_hourly"],
    "refetched_current": ORACLES["current_obs"],
    "bad_records": O.sql("""select location_id, reason, count(*) as records from (
        select case when year(date) % 4 = 0 then null else location_id end as location_id,
          case year(date) % 4 when 0 then 'malformed document' when 1 then case when k = 1 then 'bad date' else 'ingested' end
               when 2 then case when k = 1 then 'bad number: temp_max' else 'ingested' end else 'ingested' end as reason, k, year(date) % 4 as kind
        from (select location_id, date, row_number() over (partition by location_id, year(date) order by date) as k from daily))
        where kind <> 0 or k = 1 group by all"""),
})


def _stop_before_commit(spark, checkpoint: str) -> None:
    """Take back Spark's commit of a stream's last batch, so that the batch runs again."""
    last = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*").load(f"{checkpoint}/commits").select(
        F.max(F.regexp_extract("path", "([0-9]+)$", 1).cast("long"))).first()[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/{last}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def q_stream_replay(spark, sf_dir):
    """T4: the last batch runs again after its compaction was committed; the view stays."""
    from stratus.streaming import features as stream_features
    source, root, ckpt = (scratch_path(spark, n) for n in ("daily-landing", "feature-store", "daily-ckpt"))
    raw = fx.raw_daily(spark, sf_dir)
    for part in (F.year("date") <= 1996, F.year("date") > 1996):
        raw.where(part).write.mode("append").parquet(source)
        stream_features.run(spark, source, root, ckpt, max_files_per_trigger=None, compact_every=1)
    _stop_before_commit(spark, ckpt)
    stream_features.run(spark, source, root, ckpt, max_files_per_trigger=None, compact_every=1)
    return stream_features.feature_view(spark, root)


def q_stream_redeliveries(spark, sf_dir):
    """Every third observation comes again, dated 26 hours later; each id is scored once, as it came first."""
    from stratus.streaming import alerts as stream_alerts
    source, sink, ckpt = (scratch_path(spark, n) for n in ("obs-landing", "obs-alerts", "obs-ckpt"))
    rows, climate = fx.observations(spark, sf_dir), hourly_climatology(spark, sf_dir)
    rows.write.parquet(source)
    stream_alerts.run(spark, source, climate, sink, ckpt)
    again = rows.where(F.col("event_id") % 3 == 0).withColumn("ts", F.col("ts") + F.expr("INTERVAL 26 HOURS"))
    again.write.mode("append").parquet(source)
    stream_alerts.run(spark, source, climate, sink, ckpt, compact_every=2)
    _stop_before_commit(spark, ckpt)
    stream_alerts.run(spark, source, climate, sink, ckpt, compact_every=2)
    return (stream_alerts.scored_observations(spark, sink).drop("late")
            .withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def _live_store(spark, sf_dir) -> str:
    """The feature store after the days up to the clock came in three landings, one of them late."""
    from stratus.streaming import features as stream_features
    source, root, ckpt = (scratch_path(spark, n) for n in ("daily-landing", "feature-store", "daily-ckpt"))
    raw = forecast.up_to(fx.raw_daily(spark, sf_dir), AS_OF)
    late = (F.year("date") == 1998) & (F.month("date") == 3)
    for part in (~late & (F.year("date") < 1998), late, ~late & (F.year("date") >= 1998)):
        raw.where(part).write.mode("append").parquet(source)
        stream_features.run(spark, source, root, ckpt, max_files_per_trigger=None)
    return root


def q_live_latest(spark, sf_dir):
    """W7 from the live store: no scan of the history."""
    from stratus.streaming import features as stream_features
    return stream_features.live_latest(spark, _live_store(spark, sf_dir)).select(
        "location_id", "latest_obs_date", "forecast_date", *TABULAR_FEATURES)


def q_live_sequence(spark, sf_dir):
    """W8 from the live store."""
    from stratus.streaming import features as stream_features
    return stream_features.live_sequence(spark, _live_store(spark, sf_dir), SEQ_LEN).select(
        "location_id", "seq_rows", "seq_start", "seq_end", F.col("seq")[0][0].alias("first_temp_mean"),
        F.col("seq")[SEQ_LEN - 1][0].alias("last_temp_mean"), F.col("seq")[SEQ_LEN - 1][10].alias("last_cos_day"))


QUERIES.update({"live_latest": q_live_latest, "live_sequence": q_live_sequence})
ORACLES.update({"live_latest": ORACLES["latest_complete"], "live_sequence": ORACLES["latest_sequence"]})

QUERIES.update({
    "stream_replay": q_stream_replay,
    "stream_redeliveries": q_stream_redeliveries,
    "stream_alerts": q_stream_alerts,
    "stream_features": q_stream_features,
    "late_observations": q_late_observations,
    "stream_corrections": q_stream_corrections,
})

ORACLES.update({
    "stream_alerts": O.sql(f"""select o.event_id, o.location_id, o.ts, f.forecast_temp,
        {_alert_sql('coalesce(f.forecast_temp, o.temperature_2m)', 'o.relative_humidity_2m', 'o.pressure_msl',
                    'o.precipitation', 'level')} as alert_level,
        {_alert_sql('coalesce(f.forecast_temp, o.temperature_2m)', 'o.relative_humidity_2m', 'o.pressure_msl',
                    'o.precipitation', 'risk')} as risk_pct,
        o.wind_speed_10m > 20 as wind_caution
        from observations o left join (select location_id, avg(temperature_2m) as forecast_temp from hourly
        group by location_id) f on f.location_id = o.location_id"""),
    "stream_features": O.sql("select * from processed"),
    "stream_replay": O.sql("select * from processed"),
    "late_observations": O.sql("""select location_id, event_id % 50 = 0
          and ts < (select max(ts) from observations where event_id % 50 <> 0) - interval 1 hour as late,
        count(*) as observations, count(distinct event_id) as events, cast(sum(event_id) as bigint) as id_sum
        from observations group by all"""),
    "stream_corrections": O.sql("select * from processed", raw=f"""select location_id, date,
        {', '.join(c for c in RAW_ORDER if c != 'pressure')},
        case when day(date) = 20 and month(date) = 6 then null else pressure end as pressure from daily"""),
})


ORACLES["stream_redeliveries"] = ORACLES["stream_alerts"]


def reset_session_caches() -> None:
    """Forget fitted models and landed payloads (benchmarks time every run from scratch)."""
    _FITTED.clear()
    fx._LANDED.clear()
