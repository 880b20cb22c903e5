"""DuckDB oracle SQL for the registered queries.

Each string runs on the driver's base tables only: the derived views are
inlined as CTEs (DuckDB skips CTEs a query does not reference).  Column
names and types mirror the Spark side exactly.
"""

from __future__ import annotations

from stratus.functions.codes import wmo_values_sql
from stratus.schemas import (LAGS, MEASURES, RAW_ORDER, ROLL_COLUMNS, ROLL_WINDOWS,
                             SEQUENCE_FEATURES, TABULAR_FEATURES, TARGET)
from stratus.sources.fixtures import (AS_OF_DAILY, AS_OF_HOURLY, DAILY_SQL, HOURLY_SQL,
                                      LOCATIONS_SQL, NATION_PLACES_SQL, NO_CODES, OBSERVATIONS_SQL,
                                      PAYLOAD_AHEAD, PAYLOAD_PAST)

RAW_COLS = ", ".join(["location_id", "date"] + RAW_ORDER)
W = "partition by location_id order by date"
AS_OF = f"date '{AS_OF_DAILY}'"


def _rolling(c: str, n: int) -> str:
    frame = f"({W} rows between {n - 1} preceding and current row)"
    return (f"case when count({c}) over {frame} = {n} "
            f"then avg({c}) over {frame} end as {c}_roll_mean_{n}")


def _seasonal(date: str = "date") -> str:
    return ", ".join([
        f"cast(month({date}) as integer) as month",
        f"cast(dayofyear({date}) as integer) as day_of_year",
        f"round(sin(2.0*pi()*month({date})/12.0), 9) as sin_month",
        f"round(cos(2.0*pi()*month({date})/12.0), 9) as cos_month",
        f"round(sin(2.0*pi()*dayofyear({date})/365.25), 9) as sin_day",
        f"round(cos(2.0*pi()*dayofyear({date})/365.25), 9) as cos_day",
    ])


def feature_select(src: str = "raw", target: bool = True) -> str:
    parts = [f"{src}.*"]
    if target:
        parts.append(f"lead(temp_mean, 1) over ({W}) as target_temp")
    parts += [f"lag({c}, {k}) over ({W}) as {c}_lag_{k}" for k in LAGS for c in MEASURES]
    parts += [_rolling(c, n) for n in ROLL_WINDOWS for c in ROLL_COLUMNS]
    parts.append(_seasonal())
    return f"select {', '.join(parts)} from {src}"


def not_null(cols: list[str]) -> str:
    return " and ".join(f"{c} is not null" for c in cols)


ALL_FEATURE_COLS = ["location_id", "date"] + RAW_ORDER + ["target_temp"] + TABULAR_FEATURES[7:]
SCALE_COLS = SEQUENCE_FEATURES + [TARGET]


def _span(c: str) -> str:
    return f"(case when {c}_max > {c}_min then {c}_max - {c}_min else 1.0 end)"


CTES = {
    "daily": DAILY_SQL,
    "raw": f"select {RAW_COLS} from daily",
    "feat": feature_select("raw"),
    "processed": f"select * from feat where {not_null(ALL_FEATURE_COLS)}",
    "split0": f"""select *, cast(row_number() over ({W}) as integer) as rn,
        count(*) over (partition by location_id) as n from processed""",
    "split1": "select *, cast(floor(0.8::double * n) as integer) as split_at from split0",
    "split": "select *, case when rn <= split_at then 'train' else 'test' end as split from split1",
    "stats": "select location_id, " + ", ".join(
        f"min({c}) as {c}_min, max({c}) as {c}_max" for c in SCALE_COLS)
        + " from split where split = 'train' group by location_id",
    "scaled": "select split.*, " + ", ".join(
        f"({c} - {c}_min) / {_span(c)} as {c}_s" for c in SCALE_COLS)
        + f", {TARGET}_min, {TARGET}_max from split join stats using (location_id)",
    "predictions": """
        select location_id, 'persistence' as model, 'baseline' as role, date,
               target_temp as actual, temp_mean as predicted from split where split = 'test'
        union all
        select location_id, 'midpoint' as model, 'sequence' as role, date,
               target_temp as actual, (temp_max + temp_mean_lag_1) / 2 as predicted
        from split where split = 'test'""",
    "model_metrics": """select location_id, model, role,
        sqrt(avg((actual - predicted) * (actual - predicted))) as rmse,
        avg(abs(actual - predicted)) as mae, count(*) as n
        from predictions group by location_id, model, role""",
    "best": """select location_id, arg_min(model, (rmse, case when role = 'sequence' then 0 else 1 end)) as model,
        min(rmse) as rmse from model_metrics group by location_id""",
    "raw_asof": f"select {RAW_COLS} from daily where date <= {AS_OF}",
    "feat_asof": feature_select("raw_asof", target=False),
    "latest": f"""select * exclude (rb), date as latest_obs_date, date + 1 as forecast_date from (
        select *, row_number() over (partition by location_id order by date desc) as rb
        from feat_asof where {not_null(TABULAR_FEATURES)}) where rb = 1""",
    "payload_rows": f"""
        select * replace (case when location_id = '{NO_CODES}' then null else weather_code end as weather_code)
        from (select * exclude (r) from (select d.*, row_number() over (partition by location_id order by date desc) as r
          from daily d where date <= {AS_OF}) where r <= {PAYLOAD_PAST}
        union all
        select * exclude (r) from (select d.*, row_number() over (partition by location_id order by date) as r
          from daily d where date > {AS_OF}) where r <= {PAYLOAD_AHEAD})""",
    "current_obs": f"""select location_id, temp_mean as temperature_2m, humidity as relative_humidity_2m,
        precipitation, pressure as pressure_msl, wind_speed as wind_speed_10m from (
        select *, row_number() over (partition by location_id order by date desc) as r
        from payload_rows where date <= {AS_OF}) where r = 1""",
    "locs": LOCATIONS_SQL,
    "offsets": """select location_id, case when longitude >= 30
        then cast(floor(longitude / 15) * 3600 as integer) end as utc_offset_seconds from locs""",
    "places": NATION_PLACES_SQL,
    "hourly": HOURLY_SQL,
    "observations": OBSERVATIONS_SQL,
    "wmo": f"select * from {wmo_values_sql()}",
}


def sql(body: str, **views: str) -> str:
    """``body`` over the derived views; ``views`` replaces some, e.g. ``daily`` by another family of places."""
    ctes = ",\n".join(f"{name} as ({text})" for name, text in (CTES | views).items())
    return f"with {ctes}\n{body}"


__all__ = ["sql", "feature_select", "not_null", "ALL_FEATURE_COLS", "SCALE_COLS", "AS_OF",
           "AS_OF_HOURLY", "SEQUENCE_FEATURES"]
