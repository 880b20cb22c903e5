"""T4: refresh lag / rolling features as new daily rows arrive.

Positional windows (lag, lead, row frames) are not supported on streaming
DataFrames, so each micro-batch is handled with ``foreachBatch`` using the
same batch feature function:

1. the batch's rows, normalised, go to a fresh folder of the raw store;
2. per touched location, the context is the last 30 stored rows before the
   batch's earliest date plus every stored row from that date on (so late
   or re-sent rows are handled, not just appends).  Only a recent date
   window of the store is read (row groups outside it are skipped by
   Parquet statistics); a location falls back to its full history only when
   the window holds fewer rows than its halo needs (a per-location row-count
   index, rewritten per batch for touched locations, bounds what it can have);
3. features are computed over the context; every row from the last pre-batch
   row onward goes to a fresh folder of the feature store, with a flag that
   says whether it is complete, so a correction that makes a row incomplete
   supersedes the complete one;
4. the live store gets, per touched place, what a forecast needs: the latest row whose
   features are complete and the last ``RECENT`` complete days, from the same context and
   the place's state before; a place whose state a correction undoes is read whole;
5. one commit (:mod:`stratus.streaming.manifest`) lists the new folders.

The stores are merge-on-read: per (location_id, date) the row from the highest
batch wins; the view keeps the complete ones.  A batch starts from what was
committed before it, so running it again, before, during or after a compaction,
gives the same view.  :func:`compact` writes the stores as their newest rows and
commits that list under the same batch, so their size follows places and days,
not batches; ``run`` does so after every ``compact_every`` batches.
"""

from __future__ import annotations

import datetime as dt

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.operators import features
from stratus.schemas import DEFAULT_SEQ_LEN, RAW_DAILY, RAW_ORDER, SEQUENCE_FEATURES, TABULAR_FEATURES, TARGET
from stratus.sources.files import PROCESSED
from stratus.session import materialize
from stratus.sources.payload import last_rows, normalise_raw
from stratus.streaming import manifest

HALO = 30   # rows of history the widest window (30-row mean) needs


FEATURES = T.StructType(PROCESSED.fields + [T.StructField("complete", T.BooleanType()),
                                            T.StructField("batch_id", T.LongType())])
STORE = T.StructType(RAW_DAILY.fields + [T.StructField("batch_id", T.LongType())])
INDEX = T.StructType([T.StructField("location_id", T.StringType()), T.StructField("n_rows", T.LongType()),
                      T.StructField("batch_id", T.LongType())])
RECENT = 14   # complete days kept for the longest sequence window
_LATEST = T.StructType([f for f in PROCESSED.fields if f.name not in ("location_id", TARGET)])
_DAY = T.StructType([f for f in RAW_DAILY.fields if f.name != "location_id"])
LIVE = T.StructType([T.StructField("location_id", T.StringType()), T.StructField("latest", _LATEST), T.StructField("recent", T.ArrayType(_DAY)),
                     T.StructField("batch_id", T.LongType())])
STORES = {"live": (LIVE, ["location_id"]), "raw": (STORE, ["location_id", "date"]), "features": (FEATURES, ["location_id", "date"]), "index": (INDEX, ["location_id"])}
LOOKBACK_DAYS = 120   # date window expected to hold the 30-row halo of a daily series


def _newest(df: DataFrame, keys: list[str], cols: list[str], version: str = "batch_id") -> DataFrame:
    pick = F.max_by(F.struct(*cols), F.col(version))
    return df.groupBy(*keys).agg(pick.alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in cols])


def _folder(spark: SparkSession, root: str, name: str) -> str:
    """The path (a pattern, if there are several) of a store's folders."""
    where = manifest.state(spark, root).folders[name]
    return f"{root}/{name}/{where[0]}" if len(where) == 1 else f"{root}/{name}/{{{','.join(where)}}}"


def compact(spark: SparkSession, root: str) -> None:
    """Rewrite raw, feature and index stores as their newest rows: one swap of the list."""
    now = manifest.state(spark, root)
    folders = {}
    for name, (schema, keys) in STORES.items():
        rows = manifest.read(spark, root, now, name, schema)
        newest = _newest(rows.withColumn("version", F.col("batch_id")), keys, [c for c in rows.columns if c not in keys], "version")
        folders[name] = [manifest.write(newest.repartitionByRange(*keys).sortWithinPartitions(*keys), root, name)]
    manifest.commit(spark, root, now.batch_id, folders)
    manifest.vacuum(spark, root)


def process_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    # The micro-batch is read twice (earliest date, raw write): keep it for the batch.
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        _process(batch, batch_id, root)
    finally:
        batch.unpersist()


def _process(batch: DataFrame, batch_id: int, root: str) -> None:
    spark = batch.sparkSession
    base = manifest.state(spark, root, before_batch=batch_id)
    earliest = batch.agg(F.min("date")).first()[0]
    if earliest is None:          # empty micro-batch
        return
    # The ingest rule of all sources; copies within a batch have no fetch time, so the greatest row wins.
    unique = normalise_raw(batch.withColumn("fetched_at", F.lit(None).cast("timestamp")))
    this = F.lit(batch_id).cast("long")
    added = {"raw": manifest.write(unique.withColumn("batch_id", this), root, "raw")}
    older = manifest.read(spark, root, base, "raw", STORE)
    new = spark.read.schema(STORE).parquet(f"{root}/raw/{added['raw']}")
    cut = new.groupBy("location_id").agg(F.min("date").alias("_cutoff"), F.count(F.lit(1)).alias("_added"))
    # Upper bound of each touched location's stored rows (re-sent rows only over-count).
    index = _newest(manifest.read(spark, root, base, "index", INDEX), ["location_id"], ["n_rows"])
    # Read only a recent date window (Parquet min/max statistics skip old row groups) ...
    start = earliest - dt.timedelta(days=LOOKBACK_DAYS)
    recent = older.where(F.col("date") >= F.lit(start))
    recent = recent.join(cut.select("location_id", "_cutoff"), "location_id").where(
        F.col("date") >= F.date_sub("_cutoff", LOOKBACK_DAYS)).drop("_cutoff")      # each place from its own cut-off
    have = (recent.join(cut, "location_id").where(F.col("date") < F.col("_cutoff"))
            .groupBy("location_id").agg(F.count(F.lit(1)).alias("_seen")))
    # ... unless a location's window holds fewer halo rows than it may have stored.
    short = (cut.join(index, "location_id", "left").join(have, "location_id", "left")
             .where(F.coalesce("_seen", F.lit(0)) < F.least(F.lit(HALO), F.coalesce("n_rows", F.lit(0))))
             .select("location_id"))
    history = (older.join(short, "location_id", "left_semi").join(cut.select("location_id", "_cutoff"), "location_id")
               .where(F.col("date") < F.date_sub("_cutoff", LOOKBACK_DAYS)).drop("_cutoff"))
    rows = recent.unionByName(history).unionByName(new).join(cut.select("location_id", "_cutoff"), "location_id")
    latest = _newest(rows, ["location_id", "date", "_cutoff"], RAW_ORDER)   # re-sent rows: newest wins

    rb = F.row_number().over(Window.partitionBy("location_id").orderBy(F.col("date").desc()))
    before = latest.where(F.col("date") < F.col("_cutoff")).withColumn("_rb", rb).where(F.col("_rb") <= HALO)
    after = latest.where(F.col("date") >= F.col("_cutoff")).withColumn("_rb", F.lit(None).cast("int"))
    context = materialize(before.unionByName(after), "feature-context")     # read by features, flags and live state
    first_emit = F.min(F.when(F.col("_rb") == 1, F.col("date"))).over(Window.partitionBy("location_id"))
    feats = features.with_features(context.drop("_cutoff")).drop("_rb")
    whole = F.lit(True)
    for c in feats.columns:
        whole = whole & F.col(c).isNotNull()
    emit = (feats.withColumn("complete", whole)
            .join(context.select("location_id", "date", "_rb"), ["location_id", "date"])
            .withColumn("_first", first_emit)
            .where(F.col("_first").isNull() | (F.col("date") >= F.col("_first")))
            .drop("_rb", "_first"))
    added["features"] = manifest.write(emit.withColumn("batch_id", this), root, "features")
    written = spark.read.schema(FEATURES).parquet(f"{root}/features/{added['features']}")
    before_state = _newest(manifest.read(spark, root, base, "live", LIVE), ["location_id"], ["latest", "recent"])
    state = _live(written, context.drop("_cutoff", "_rb"), before_state, index, spark, root, base, new)
    added["live"] = manifest.write(state.withColumn("batch_id", this), root, "live")
    touched = (cut.join(index, "location_id", "left")
               .select("location_id", (F.coalesce("n_rows", F.lit(0)) + F.col("_added")).alias("n_rows")))
    added["index"] = manifest.write(touched.withColumn("batch_id", this), root, "index")
    manifest.commit(spark, root, batch_id, {name: [*base.folders.get(name, []), folder] for name, folder in added.items()})


def _present(cols: list[str]):
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    return whole


def _last_days(rows: DataFrame) -> DataFrame:
    """``location_id, recent``: the last ``RECENT`` days with all measures, in order."""
    kept = last_rows(rows.where(_present(RAW_ORDER)), RECENT)
    return kept.groupBy("location_id").agg(F.array_sort(F.collect_list(F.struct("date", *RAW_ORDER))).alias("recent"))


def _latest(rows: DataFrame) -> DataFrame:
    """``location_id, latest``: the last row with all features (the target may be missing)."""
    return rows.where(_present(TABULAR_FEATURES)).groupBy("location_id").agg(
        F.max_by(F.struct(*_LATEST.fieldNames()), "date").alias("latest"))


def _live(made: DataFrame, context: DataFrame, before: DataFrame, index: DataFrame, spark: SparkSession, root: str,
          base: manifest.State, new: DataFrame) -> DataFrame:
    """Live state of the places of a batch.  ``made``: their recomputed features; ``context``: the
    days these were made from; ``before``: the state so far."""
    days = context.select("location_id", "date", *RAW_ORDER)
    spans = days.groupBy("location_id").agg(F.min("date").alias("_from"), F.count(F.lit(1)).alias("_days"))
    firsts = made.groupBy("location_id").agg(F.min("date").alias("_first"))
    known = (spans.join(firsts, "location_id").join(before, "location_id", "left").join(index, "location_id", "left")
             .join(_latest(made).withColumnRenamed("latest", "_new"), "location_id", "left")
             .join(_last_days(days).withColumnRenamed("recent", "_found"), "location_id", "left"))
    none = F.array().cast(LIVE["recent"].dataType)
    older = F.filter(F.coalesce("recent", none), lambda d: d["date"] < F.col("_from"))
    joined = F.concat(older, F.coalesce("_found", none))
    kept = F.slice(joined, F.greatest(F.size(joined) - RECENT + 1, F.lit(1)), RECENT)
    latest = F.coalesce("_new", F.when(F.col("latest.date") < F.col("_first"), F.col("latest")))
    undone = ((F.col("_new").isNull() & (F.col("latest.date") >= F.col("_first")))
              | ((F.size(kept) < RECENT) & (F.coalesce("n_rows", F.lit(0)) > F.col("_days"))))
    # Written: whether a place must be read whole is asked before the answer is used.
    state = materialize(known.select("location_id", latest.alias("latest"), kept.alias("recent"), F.coalesce(undone, F.lit(False)).alias("undone")),
                        "live-state")
    again = state.where("undone").select("location_id")
    good = state.where(~F.col("undone")).drop("undone")
    if again.isEmpty():
        return good
    stored = manifest.read(spark, root, base, "raw", STORE).unionByName(new).join(again, "location_id", "left_semi")
    whole = _newest(stored, ["location_id", "date"], RAW_ORDER)
    redone = _last_days(whole).join(_latest(features.with_features(whole)), "location_id", "full")
    return good.unionByName(redone.select("location_id", "latest", F.coalesce("recent", none).alias("recent")))


def run(spark: SparkSession, source: str, root: str, checkpoint: str,
        max_files_per_trigger: int | None = 1, compact_every: int = 16) -> None:
    manifest.begin(spark, root)

    def step(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, batch_id, root)
        if (batch_id + 1) % compact_every == 0:
            compact(spark, root)

    reader = spark.readStream.schema(RAW_DAILY)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    query = (reader.parquet(source).writeStream
             .foreachBatch(step)
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def feature_view(spark: SparkSession, root: str) -> DataFrame:
    """Merge-on-read: the newest batch's row per (location_id, date), if it is complete."""
    out = manifest.read(spark, root, manifest.state(spark, root), "features", FEATURES)
    cols = [c for c in out.columns if c not in ("location_id", "date", "batch_id")]
    return _newest(out, ["location_id", "date"], cols).where("complete").drop("complete")


def _live_view(spark: SparkSession, root: str) -> DataFrame:
    return _newest(manifest.read(spark, root, manifest.state(spark, root), "live", LIVE), ["location_id"], ["latest", "recent"])


def live_latest(spark: SparkSession, root: str) -> DataFrame:
    """W7 from the live store: what ``forecast.latest_complete`` finds in all stored days, without reading them."""
    rows = _live_view(spark, root).where("latest IS NOT NULL").select("location_id", "latest.*")
    return rows.withColumns({"latest_obs_date": F.col("date"), "forecast_date": F.date_add("date", 1)})


def live_sequence(spark: SparkSession, root: str, seq_len: int = DEFAULT_SEQ_LEN) -> DataFrame:
    """W8 from the live store: the sequences of ``sequences.latest_sequence`` over all stored days."""
    if seq_len > RECENT:
        raise ValueError(f"the live store keeps {RECENT} days")
    days = F.slice("recent", F.size("recent") - seq_len + 1, seq_len)
    rows = _live_view(spark, root).where(F.size("recent") >= seq_len).select("location_id", days.alias("days"))

    def inputs(day):
        made = features.seasonal_columns(day["date"])
        return F.array(*[day[c] if c in RAW_ORDER else made[c] for c in SEQUENCE_FEATURES])
    return rows.select("location_id", F.size("days").cast("long").alias("seq_rows"), F.col("days")[0]["date"].alias("seq_start"),
                       F.col("days")[seq_len - 1]["date"].alias("seq_end"), F.transform("days", inputs).alias("seq"))
