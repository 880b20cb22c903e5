"""Alert scoring of each new observation with Structured Streaming.

Observation files land in a folder; a file-source stream reads them with a fixed
schema.  Ids are unique over all time: a streaming aggregate per ``event_id`` keeps in the
state store (RocksDB) the batch in which the id came first, and that batch's earliest row.
It combines map-side, so a storm of one id is one row per task before the shuffle; a batch
touches the state of its own ids only, whatever day their times lie on and however many
batches there were.  An id is new in the batch that is its first and its last so far; all
others are re-deliveries, also with a corrected time, and the row scored first stays.

New observations are joined to the latest batch forecast of their location (a table
that may grow, left to Catalyst) and run through the alert cascade and the wind caution.
No observation is lost, however late.  One is late when its event time lies more than
``delay`` behind the newest event time of the batches before its own; late rows are scored
and stored like any other, marked ``late``; :func:`late_observations` lists them.

Each batch's rows are a folder listed by one commit (:mod:`stratus.streaming.manifest`),
which also notes the newest event time; a batch that is run again replaces its own commit.
:func:`compact` writes the sink as few files, ordered by time.  The checkpoint lies in the
shared folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.operators import alerts
from stratus.schemas import HIGH_WIND
from stratus.session import materialize
from stratus.streaming import manifest

OBSERVATION = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("location_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("temperature_2m", T.DoubleType()),
    T.StructField("relative_humidity_2m", T.DoubleType()),
    T.StructField("wind_speed_10m", T.DoubleType()),
    T.StructField("pressure_msl", T.DoubleType()),
    T.StructField("precipitation", T.DoubleType()),
])

DELAY = "1 hour"
ALERT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("location_id", T.StringType()),
    T.StructField("ts", T.TimestampType()), T.StructField("forecast_temp", T.DoubleType()),
    T.StructField("alert_level", T.StringType()), T.StructField("risk_pct", T.DoubleType()),
    T.StructField("wind_caution", T.BooleanType()), T.StructField("late", T.BooleanType()),
])
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_deliveries(observations: DataFrame) -> DataFrame:
    """Per ``event_id`` the time of its first and of its last batch, and the earliest row
    (then the least) of the first.  On a stream: the ids that a batch touches."""
    body = [f for f in OBSERVATION.fieldNames() if f != "event_id"]
    arrived = observations.withColumn("_at", F.current_timestamp())       # a stream fixes it per batch
    first = F.min_by(F.struct(*body), F.struct("_at", "ts", *[c for c in body if c != "ts"]))
    return arrived.groupBy("event_id").agg(F.min("_at").alias("first_at"), F.max("_at").alias("last_at"), first.alias("v"))


def new_rows(touched: DataFrame) -> DataFrame:
    """Observations whose id came in this batch for the first time."""
    body = [f for f in OBSERVATION.fieldNames() if f != "event_id"]
    return touched.where("first_at = last_at").select("event_id", *[F.col(f"v.{c}").alias(c) for c in body])


def score(observations: DataFrame, forecasts: DataFrame) -> DataFrame:
    """One scored row per (already distinct) observation."""
    joined = observations.join(forecasts.select("location_id", "forecast_temp"), "location_id", "left")
    temp = F.coalesce(F.col("forecast_temp"), F.col("temperature_2m"))
    a = alerts.alert(temp, F.col("relative_humidity_2m"), F.col("pressure_msl"), F.col("precipitation"))
    return joined.withColumn("_a", a).select(
        "event_id", "location_id", "ts", "forecast_temp",
        F.col("_a.level").alias("alert_level"), F.col("_a.risk").alias("risk_pct"),
        (F.col("wind_speed_10m") > HIGH_WIND).alias("wind_caution"))


def _merge(touched: DataFrame, batch_id: int, forecasts: DataFrame, sink: str, delay: str) -> None:
    spark = touched.sparkSession
    base = manifest.state(spark, sink, before_batch=batch_id)
    fresh = materialize(new_rows(touched), "observation-batch")
    late = F.coalesce(F.col("ts") < F.lit(base.note).cast("timestamp") - F.expr(f"INTERVAL {delay}"), F.lit(False))
    folder = manifest.write(score(fresh, forecasts).withColumn("late", late), sink, "alerts")
    # One value: the newest event time so far.
    newest = fresh.agg(F.greatest(F.max("ts"), F.lit(base.note).cast("timestamp")).cast("string")).first()[0]
    manifest.commit(spark, sink, batch_id, {"alerts": [*base.folders.get("alerts", []), folder]}, newest)


def compact(spark: SparkSession, sink: str) -> None:
    """Rewrite the scored rows ordered by time: one swap of the list."""
    now = manifest.state(spark, sink)
    rows = manifest.read(spark, sink, now, "alerts", ALERT)
    folder = manifest.write(rows.repartitionByRange("ts", "event_id").sortWithinPartitions("ts"), sink, "alerts")
    manifest.commit(spark, sink, now.batch_id, {"alerts": [folder]}, now.note)
    manifest.vacuum(spark, sink)


def run(spark: SparkSession, source: str, forecasts: DataFrame, sink: str, checkpoint: str,
        max_files_per_trigger: int | None = None, delay: str = DELAY, compact_every: int = 16) -> None:
    """Process everything landed so far (``availableNow``) and stop.

    The static side is written once to the shared folder first: each batch then
    reads a small Parquet table instead of recomputing the forecasts.
    """
    forecasts = materialize(forecasts.select("location_id", "forecast_temp"), "alert-forecasts")
    manifest.begin(spark, sink)

    def step(touched: DataFrame, batch_id: int) -> None:
        _merge(touched, batch_id, forecasts, sink, delay)
        if (batch_id + 1) % compact_every == 0:
            compact(spark, sink)

    reader = spark.readStream.schema(OBSERVATION)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        query = (first_deliveries(reader.parquet(source)).writeStream.outputMode("update")
                 .foreachBatch(step).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before)


def scored_observations(spark: SparkSession, sink: str) -> DataFrame:
    return manifest.read(spark, sink, manifest.state(spark, sink), "alerts", ALERT)


def late_observations(spark: SparkSession, sink: str) -> DataFrame:
    """The scored observations that came more than the delay behind."""
    return scored_observations(spark, sink).where("late")
