"""Weather-shaped views derived from the driver's testdata tables.

The weather application reads landed provider payloads; the test tables are a
TPC-H-like star schema plus an event log.  These views map them onto the
``raw_daily`` / ``hourly`` / ``locations`` shapes.  Every measure is a whole or
half value so window sums are exact and results are bit-comparable across
engines.  The SQL text constants below are what the DuckDB oracle runs.

Scale notes
-----------
* ``lineitem`` is the only table that grows fast.  ``nation`` (25 rows) and
  ``region`` (5 rows) are fixed-size dimensions and are broadcast by hint.
  ``supplier`` grows with the scale factor (10,000 rows per unit): its join
  carries no hint, Catalyst and AQE choose the strategy from its bytes.
* Two families of places: the 5 regions and event types, and places whose number
  grows with the data (``by="supplier"``, ``by="user"``).
* The daily aggregate is decomposable (min/max/sum), so the hash aggregate
  combines map-side before its shuffle: a location holding a third of all
  lineitems still shuffles at most one partial row per (location, day, task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- SQL text
_DAILY_SQL = """
select {place} as location_id, cast(l_shipdate as date) as date,
 max(l_quantity) as temp_max, min(l_quantity) as temp_min, (max(l_quantity)+min(l_quantity))/2 as temp_mean,
 cast(max(round(l_discount*100)) as double)*10 as humidity,
 cast(min(round(l_tax*100)) as double) as precipitation,
 cast(floor(min(l_extendedprice)/2500) as double) as wind_speed,
 cast(990+floor(max(l_extendedprice)/2500) as double) as pressure,
 cast(sum(l_partkey)%100 as int) as weather_code
from lineitem join supplier on l_suppkey=s_suppkey join nation on s_nationkey=n_nationkey
 join region on n_regionkey=r_regionkey
group by {place}, cast(l_shipdate as date)
"""
DAILY_PLACE_SQL = {"region": "r_name", "supplier": "'S' || cast(l_suppkey as varchar)"}
DAILY_SQL = _DAILY_SQL.format(place=DAILY_PLACE_SQL["region"])
SUPPLIER_DAILY_SQL = _DAILY_SQL.format(place=DAILY_PLACE_SQL["supplier"])

_HOURLY_SQL = """
select {place} as location_id, cast(date_trunc('hour', ts) as timestamp) as ts,
 cast(max(floor(value/10)) as double) as temperature_2m,
 cast(min(user_id)%101 as double) as relative_humidity_2m,
 cast(count(*)%101 as int) as precipitation_probability,
 cast(max(user_id)%40 as double) as wind_speed_10m,
 cast(980+max(user_id)%60 as double) as pressure_msl,
 cast(max(event_id)%100 as int) as weather_code
from events group by {place}, date_trunc('hour', ts)
"""
HOURLY_PLACE_SQL = {"event": "event_type", "user": "'U' || cast(user_id as varchar)"}
HOURLY_SQL = _HOURLY_SQL.format(place=HOURLY_PLACE_SQL["event"])
USER_HOURLY_SQL = _HOURLY_SQL.format(place=HOURLY_PLACE_SQL["user"])

# One place per nation (F9 fixture): admin2 is null for even keys.
NATION_PLACES_SQL = """
select n_name as location_id, n_name as name, r_name as admin1,
 case when n_nationkey % 2 = 0 then null else n_name end as admin2,
 'Testland' as country, cast(n_nationkey - 12 as double) as latitude,
 cast(4 * n_nationkey as double) as longitude
from nation join region on n_regionkey = r_regionkey
"""

# One place per region (the daily series' locations): centroid of its nations.
LOCATIONS_SQL = """
select r_name as location_id, r_name as name, cast(null as varchar) as admin1,
 cast(null as varchar) as admin2, 'Testland' as country,
 avg(cast(n_nationkey - 12 as double)) as latitude, avg(cast(4 * n_nationkey as double)) as longitude
from nation join region on n_regionkey = r_regionkey
group by r_name
"""

# Fixed clocks of the fixtures (never the wall clock).
AS_OF_DAILY = "2001-06-01"
AS_OF_HOURLY = "2024-01-15 06:30:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str, by: str = "region") -> DataFrame:
    """raw_daily + weather_code, one row per (location_id, date).

    ``by``: the places are regions (5) or suppliers (as many as the data has).
    Star layout: lineitem probes supplier, nation and region one by one; the two
    fixed-size ones are broadcast by hint.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_partkey", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    place = {"region": F.col("r_name"), "supplier": F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))}[by]
    joined = (li.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
              .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
              .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")))
    agg = joined.groupBy(place.alias("location_id"),
                         F.to_date("l_shipdate").alias("date")).agg(
        F.max("l_quantity").alias("temp_max"),
        F.min("l_quantity").alias("temp_min"),
        F.max(F.round(F.col("l_discount") * 100)).alias("_hum"),
        F.min(F.round(F.col("l_tax") * 100)).alias("_rain"),
        F.min("l_extendedprice").alias("_pmin"),
        F.max("l_extendedprice").alias("_pmax"),
        F.sum("l_partkey").alias("_code"),
    )
    return agg.select(
        "location_id", "date", "temp_max", "temp_min",
        ((F.col("temp_max") + F.col("temp_min")) / 2).alias("temp_mean"),
        (F.col("_hum").cast("double") * 10).alias("humidity"),
        F.col("_rain").cast("double").alias("precipitation"),
        F.floor(F.col("_pmin") / 2500).cast("double").alias("wind_speed"),
        (F.floor(F.col("_pmax") / 2500) + 990).cast("double").alias("pressure"),
        (F.col("_code") % 100).cast("int").alias("weather_code"),
    )


def raw_daily(spark: SparkSession, sf_dir: str, by: str = "region") -> DataFrame:
    """The canonical daily table (no weather code)."""
    return daily(spark, sf_dir, by).drop("weather_code")


def hourly(spark: SparkSession, sf_dir: str, by: str = "event") -> DataFrame:
    """Hourly telemetry rows per (location_id, ts); places are event types or users."""
    place = {"event": F.col("event_type"), "user": F.concat(F.lit("U"), F.col("user_id").cast("string"))}[by]
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    agg = ev.groupBy(place.alias("location_id"),
                     F.date_trunc("hour", F.col("ts")).alias("_ts")).agg(
        F.max(F.floor(F.col("value") / 10)).alias("_t"),
        F.min("user_id").alias("_umin"),
        F.count(F.lit(1)).alias("_n"),
        F.max("user_id").alias("_umax"),
        F.max("event_id").alias("_emax"),
    )
    return agg.select(
        "location_id", F.col("_ts").cast("timestamp_ntz").alias("ts"),
        F.col("_t").cast("double").alias("temperature_2m"),
        (F.col("_umin") % 101).cast("double").alias("relative_humidity_2m"),
        (F.col("_n") % 101).cast("int").alias("precipitation_probability"),
        (F.col("_umax") % 40).cast("double").alias("wind_speed_10m"),
        (F.col("_umax") % 60 + 980).cast("double").alias("pressure_msl"),
        (F.col("_emax") % 100).cast("int").alias("weather_code"),
    )


def nation_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_name").alias("location_id"), F.col("n_name").alias("name"),
                    F.col("r_name").alias("admin1"),
                    F.when(F.col("n_nationkey") % 2 == 0, F.lit(None).cast("string"))
                     .otherwise(F.col("n_name")).alias("admin2"),
                    F.lit("Testland").alias("country"),
                    (F.col("n_nationkey") - 12).cast("double").alias("latitude"),
                    (F.col("n_nationkey") * 4).cast("double").alias("longitude")))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One place per daily-series location (region), at its nations' centroid."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
            .groupBy(F.col("r_name").alias("location_id"))
            .agg(F.avg((F.col("n_nationkey") - 12).cast("double")).alias("latitude"),
                 F.avg((F.col("n_nationkey") * 4).cast("double")).alias("longitude"))
            .select("location_id", F.col("location_id").alias("name"),
                    F.lit(None).cast("string").alias("admin1"),
                    F.lit(None).cast("string").alias("admin2"),
                    F.lit("Testland").alias("country"), "latitude", "longitude"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log as point observations (stream source rows), ts as TIMESTAMP."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id", F.col("event_type").alias("location_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.floor(F.col("value") / 10).cast("double").alias("temperature_2m"),
        (F.col("user_id") % 101).cast("double").alias("relative_humidity_2m"),
        (F.col("user_id") % 40).cast("double").alias("wind_speed_10m"),
        (F.col("user_id") % 60 + 980).cast("double").alias("pressure_msl"),
        (F.col("event_id") % 11).cast("double").alias("precipitation"),
    )


OBSERVATIONS_SQL = """
select event_id, event_type as location_id, cast(ts as timestamp) as ts,
 cast(floor(value/10) as double) as temperature_2m,
 cast(user_id%101 as double) as relative_humidity_2m,
 cast(user_id%40 as double) as wind_speed_10m,
 cast(980+user_id%60 as double) as pressure_msl,
 cast(event_id%11 as double) as precipitation
from events
"""


# ---------------------------------------------------------------- landed payloads
PAYLOAD_PAST = 32     # rows up to and including as_of
PAYLOAD_AHEAD = 9     # rows after as_of
NO_CODES = "ASIA"     # the place whose feed has no weather codes


def payload_source_rows(spark: SparkSession, sf_dir: str, as_of: str = AS_OF_DAILY) -> DataFrame:
    """Per location the last 32 rows up to as_of and the first 9 after it."""
    from pyspark.sql import Window
    d = daily(spark, sf_dir)
    cut = F.lit(as_of).cast("date")
    w_desc = Window.partitionBy("location_id").orderBy(F.col("date").desc())
    w_asc = Window.partitionBy("location_id").orderBy("date")
    past = d.where(F.col("date") <= cut).withColumn("_r", F.row_number().over(w_desc)).where(
        F.col("_r") <= PAYLOAD_PAST)
    ahead = d.where(F.col("date") > cut).withColumn("_r", F.row_number().over(w_asc)).where(
        F.col("_r") <= PAYLOAD_AHEAD)
    rows = past.unionByName(ahead).drop("_r")
    # A feed without codes: its forecast day has no label of its own (J1's fallback).
    return rows.withColumn("weather_code", F.when(F.col("location_id") != NO_CODES, F.col("weather_code")))


def utc_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset from the place's longitude; none for the westernmost places (default applies)."""
    return locations(spark, sf_dir).select(
        "location_id",
        F.when(F.col("longitude") >= 30, (F.floor(F.col("longitude") / 15) * 3600).cast("int"))
         .alias("utc_offset_seconds"))


def hourly_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset of each hourly place from its name; none for names before "d" (default applies)."""
    return hourly(spark, sf_dir).select("location_id").distinct().withColumn(
        "utc_offset_seconds", F.when(F.col("location_id") >= "d", (F.ascii("location_id") % 7 - 3) * 3600).cast("int"))


def land_forecast_payloads(spark: SparkSession, sf_dir: str, path: str,
                           as_of: str = AS_OF_DAILY) -> None:
    """Write one forecast payload document per location (JSON lines)."""
    from stratus.sources.payload import nest_daily
    rows = payload_source_rows(spark, sf_dir, as_of)
    block = nest_daily(rows, ["location_id"], with_code=True)
    block = block.withColumn("daily", F.when(F.col("location_id") != NO_CODES, F.col("daily"))
                             .otherwise(F.col("daily").withField("weather_code", F.lit(None).cast("array<int>"))))
    latest = (rows.where(F.col("date") <= F.lit(as_of).cast("date"))
              .groupBy("location_id").agg(F.max_by(F.struct(
                  F.col("temp_mean").alias("temperature_2m"),
                  F.col("humidity").alias("relative_humidity_2m"),
                  F.col("precipitation").alias("precipitation"),
                  F.col("pressure").alias("pressure_msl"),
                  F.col("wind_speed").alias("wind_speed_10m")), F.col("date")).alias("current")))
    (block.join(latest, "location_id", "left").join(utc_offsets(spark, sf_dir), "location_id", "left")
     .select("location_id", F.lit(as_of).cast("timestamp").alias("fetched_at"), "utc_offset_seconds",
             "current", "daily", F.lit(None).cast(
                 "struct<time:array<string>,temperature_2m:array<double>>").alias("hourly"))
     .write.mode("overwrite").json(path))


def land_archive_payloads(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Archive payloads by (location, year), fetched twice: the 2001 fetch holds
    stale temperatures for 2000 onward which the 2002 re-fetch corrects; one
    document per location lacks its daily block (a reject)."""
    from stratus.sources.payload import nest_daily
    d = daily(spark, sf_dir).drop("weather_code").withColumn("_year", F.year("date"))
    stale = d.withColumn("temp_max", F.when(F.col("_year") >= 2000, F.col("temp_max") + 100)
                         .otherwise(F.col("temp_max")))
    first = nest_daily(stale, ["location_id", "_year"]).withColumn(
        "fetched_at", F.lit("2001-01-01 00:00:00").cast("timestamp"))
    again = nest_daily(d.where(F.col("_year") >= 2000), ["location_id", "_year"]).withColumn(
        "fetched_at", F.lit("2002-01-01 00:00:00").cast("timestamp"))
    empty = d.select("location_id").distinct().select(
        "location_id", F.lit(None).cast("int").alias("_year"), F.lit(None).alias("daily"),
        F.lit("2002-01-02 00:00:00").cast("timestamp").alias("fetched_at"))
    cols = ["location_id", "fetched_at", "daily"]
    (first.select(cols).unionByName(again.select(cols))
     .unionByName(empty.select("location_id", "fetched_at",
                               F.col("daily").cast(first.schema["daily"].dataType)))
     .write.mode("overwrite").json(path))


def land_broken_payloads(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Archive documents by (location, year): in every fourth year one is cut in half, in the
    next its first day has no readable date, in the next that day's highest temperature is a word."""
    from stratus.sources.payload import nest_daily
    year = F.year("date")
    docs = nest_daily(daily(spark, sf_dir).drop("weather_code").withColumn("_year", year), ["location_id", "_year"])
    text = F.to_json(F.struct("location_id", F.lit("2002-01-01T00:00:00.000Z").alias("fetched_at"), "daily"))
    kind = F.col("_year") % 4
    value = (F.when(kind == 0, F.expr("left(doc, cast(length(doc) / 2 as int))"))
             .when(kind == 1, F.regexp_replace("doc", '"time":\\["', '"time":["x'))
             .when(kind == 2, F.regexp_replace("doc", '"temperature_2m_max":\\[[0-9.]+', '"temperature_2m_max":["warm"'))
             .otherwise(F.col("doc")))
    docs.withColumn("doc", text).select(value.alias("value")).write.mode("append").option("compression", "none").text(path)


def land_refetched_payloads(spark: SparkSession, sf_dir: str, path: str, fetch: int, off: float) -> None:
    """The hourly and current blocks of all places, fetched ``fetch`` days after the first, wrong by ``off``."""
    hours = hourly(spark, sf_dir).withColumn("temperature_2m", F.col("temperature_2m") + off).withColumn("_day", F.to_date("ts"))
    fields = ["temperature_2m", "relative_humidity_2m", "precipitation_probability", "wind_speed_10m", "pressure_msl", "weather_code"]
    value = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("time"), *fields)
    agg = hours.groupBy("location_id", "_day").agg(F.array_sort(F.collect_list(value)).alias("_r"))
    stamp = F.timestamp_add("DAY", F.lit(fetch), F.lit("2002-01-01 00:00:00").cast("timestamp")).alias("fetched_at")
    block = F.struct(*[F.transform("_r", _pick(f)).alias(f) for f in ["time"] + fields])
    agg.select("location_id", stamp, block.alias("hourly")).write.mode("append").json(path)
    last = F.max_by(F.struct((F.col("temp_mean") + off).alias("temperature_2m"), F.col("humidity").alias("relative_humidity_2m"),
                             "precipitation", F.col("pressure").alias("pressure_msl"), F.col("wind_speed").alias("wind_speed_10m")), "date")
    now = daily(spark, sf_dir).where(F.col("date") <= F.lit(AS_OF_DAILY).cast("date")).groupBy("location_id").agg(last.alias("current"))
    now.select("location_id", stamp, "current").write.mode("append").json(path)


def land_csv_deliveries(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Raw CSV in two deliveries: the first has stale temperatures for 2000 onward, the
    second all days of 2000 onward; both write NaN for the pressure of every 13th."""
    raw = raw_daily(spark, sf_dir).withColumn(
        "pressure", F.when(F.dayofmonth("date") == 13, F.lit(float("nan"))).otherwise(F.col("pressure")))
    recent = F.year("date") >= 2000
    stale = raw.withColumn("temp_max", F.when(recent, F.col("temp_max") + 100).otherwise(F.col("temp_max")))
    for rows in (stale, raw.where(recent)):
        rows.write.mode("append").option("header", True).csv(path)


def live_feed_ok(location_id):
    """Fixture rule for failed live fetches: places named from "M" on get no
    live payload, so the cached-payload fallback (S14) has work to do."""
    return location_id < F.lit("M")


_LANDED: dict[tuple, str] = {}


def forecast_payloads(spark: SparkSession, sf_dir: str, as_of: str = AS_OF_DAILY) -> DataFrame:
    """Land the payloads under the shared folder (once per session) and read them back."""
    from stratus.session import scratch_path
    from stratus.sources.payload import read_forecast
    key = (spark.sparkContext.applicationId, sf_dir, as_of)
    if key not in _LANDED:
        path = scratch_path(spark, "forecast-payload")
        land_forecast_payloads(spark, sf_dir, path, as_of)
        _LANDED[key] = path
    return read_forecast(spark, _LANDED[key])


def land_hourly_payloads(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Hourly forecast blocks (S8) for the hourly places, one document per place and day."""
    h = hourly(spark, sf_dir).withColumn("_day", F.to_date("ts"))
    fields = ["temperature_2m", "relative_humidity_2m", "precipitation_probability",
              "wind_speed_10m", "pressure_msl", "weather_code"]
    value = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("time"), *fields)
    agg = h.groupBy("location_id", "_day").agg(F.array_sort(F.collect_list(value)).alias("_r"))
    block = F.struct(*[F.transform("_r", _pick(f)).alias(f) for f in ["time"] + fields])
    (agg.select("location_id", F.col("_day").cast("timestamp").alias("fetched_at"), block.alias("hourly"))
     .write.mode("overwrite").json(path))


def _pick(name: str):
    return lambda r: r[name]


def coordinate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry texts per nation place: ``lat,lon``, of every five one without a
    comma, one with one good part, one with three, and the place label (every
    seventh one is blank)."""
    p = nation_places(spark, sf_dir).join(table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("location_id"), "n_nationkey"), "location_id")
    key = F.col("n_nationkey") % 5
    text = F.when(key == 0, F.concat(F.lit("lat"), F.col("latitude").cast("string")))\
        .when(key == 1, F.concat(F.col("latitude").cast("string"), F.lit(",abc")))\
        .when(key == 2, F.lit("1,2,3"))\
        .otherwise(F.concat_ws(",", F.col("latitude").cast("string"), F.col("longitude").cast("string")))
    label = F.when(F.col("n_nationkey") % 7 == 0, F.lit(" ")).otherwise(F.col("name"))
    return p.select("location_id", text.alias("coordinates"), label.alias("label"))
