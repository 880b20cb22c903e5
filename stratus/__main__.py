"""Command line: ``python -m stratus <command> ...``.

  train     raw daily rows (CSV with the raw schema, or archive payload JSON)
            -> features, both models, evaluation, metrics CSV, best-model registry
  evaluate  re-run the evaluation job on a trained root
  forecast  forecast payload JSON + trained root, or serving registry -> forecast/alert
            documents (JSON); with ``--stored`` places without a feed are served from storage
  retrain   train on some places' rows; the new models take over these places in the registry
  tune      pick window length and parameters, train the winner, register it for all its places

Outputs go below ``--root`` (default: a fresh folder under spark.checkpoint.dir).
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _session(master: str | None) -> SparkSession:
    if master:
        from stratus.session import build_session
        return build_session(master=master)
    return SparkSession.builder.getOrCreate()


def _raw(spark: SparkSession, path: str, fmt: str, location_id: str | None = None):
    from stratus.sources import files, payload
    if fmt == "csv":
        return files.read_raw_csv(spark, path, location_id)
    if fmt == "payload":
        return payload.ingest_archive(payload.read_archive(spark, path))
    return files.read_raw_parquet(spark, path)


def train(args) -> None:
    from stratus.plans import jobs, models
    spark = _session(args.master)
    params = models.ForestParams(num_trees=args.trees, max_depth=args.depth)
    raw = _raw(spark, args.raw, args.format, args.location_id)
    result = jobs.train(spark, raw, args.root, params, args.seq_kind, args.seq_len)
    print(f"root: {result.root}  processed rows: {result.processed_rows}")
    result.outputs["metrics"].orderBy("location_id", "model").show(truncate=False)
    result.outputs["best_model"].orderBy("location_id").show(truncate=False)


def evaluate(args) -> None:
    from stratus.plans import jobs
    spark = _session(args.master)
    out = jobs.evaluate(spark, args.root, args.seq_kind, args.seq_len)
    out["metrics"].orderBy("location_id", "model").show(truncate=False)
    out["top_importances"].show(truncate=False)


def forecast(args) -> None:
    from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel
    from stratus.operators import forecast as fc
    from stratus.plans import jobs, models
    from stratus.session import materialize
    from stratus.sources import files, payload
    spark = _session(args.master)
    payloads = payload.read_forecast(spark, args.payload, multi_line=args.multi_line)
    rows = payload.dedupe_daily(payload.daily_rows(payloads, with_code=True))
    current = payload.current_obs(payloads).drop("fetched_at", "utc_offset_seconds")
    if args.stored:     # places without a feed: their last stored days
        stored = fc.up_to(_raw(spark, args.stored, args.stored_format), args.as_of)
        current = current.unionByName(payload.cached_current(stored, rows))
        rows = payload.cached_payload_rows(stored, rows).drop("source")
    rows = materialize(rows, "forecast-rows")
    places = spark.read.parquet(args.locations) if args.locations else rows.select("location_id").distinct() \
        .select("location_id", F.col("location_id").alias("name"), *[F.lit(None).cast(t).alias(c) for c, t in
                [("admin1", "string"), ("admin2", "string"), ("country", "string"),
                 ("latitude", "double"), ("longitude", "double")]])
    if args.serving:
        chosen, lost = jobs.serve(spark, args.serving, rows, args.as_of)
        lost = lost.select("location_id", "model", "reason")
    else:
        forest = models.load_pipeline(os.path.join(args.root, "models", "forest"))
        loader = LinearRegressionModel if models.check_kind(args.seq_kind) == "linear" else GBTRegressionModel
        seq_model = loader.load(os.path.join(args.root, "models", models.sequence_name(args.seq_kind)))
        stats = spark.read.parquet(os.path.join(args.root, "models", "scaler"))
        seq_fc, rejects = models.forecast_sequence(seq_model, stats, rows, args.as_of,
                                                   models.sequence_name(args.seq_kind), args.seq_len)
        forecasts = models.forecast_forest(forest, rows, args.as_of).unionByName(seq_fc)
        registry = spark.read.parquet(os.path.join(args.root, "best_model"))
        best = files.best_model_for(places, registry)
        chosen = fc.choose_forecast(forecasts, best)
        short = rejects.select("location_id", F.lit(None).cast("string").alias("model"), "reason")
        lost = fc.forecast_rejects(forecasts, best).unionByName(short)
    # Every place is in the export or in the rejects beside it.
    lost.write.mode("overwrite").json(args.out.rstrip("/") + "-rejects")
    doc = fc.export_rows(chosen, current, places, args.stamp or f"{args.as_of} 00:00:00")
    files.write_export(doc, args.out)
    print(f"wrote {args.out}; rejects beside it in {args.out.rstrip('/')}-rejects")


def retrain(args) -> None:
    from stratus.plans import jobs, models
    spark = _session(args.master)
    chosen = spark.createDataFrame([(p,) for p in args.places.split(",")], "location_id string")
    params = models.ForestParams(num_trees=args.trees, max_depth=args.depth)
    result = jobs.retrain_locations(spark, _raw(spark, args.raw, args.format), chosen, args.root, serving=args.serving,
                                    forest=params, seq_kind=args.seq_kind, seq_len=args.seq_len)
    print(f"root: {result.root}  registered in {args.serving}")


def tune(args) -> None:
    from stratus.plans import jobs, models
    spark = _session(args.master)
    params = models.ForestParams(num_trees=args.trees, max_depth=args.depth)
    result = jobs.tune(spark, _raw(spark, args.raw, args.format), args.serving, kind=args.seq_kind, root=args.root, forest=params)
    print(f"root: {result.root}  registered in {args.serving}")


def main() -> None:
    ap = argparse.ArgumentParser(prog="stratus")
    ap.add_argument("--master", help="e.g. local[8]; default: the ambient session")
    sub = ap.add_subparsers(dest="cmd", required=True)
    for name in ("train", "retrain", "tune"):
        t = sub.add_parser(name)
        t.add_argument("--raw", required=True)
        t.add_argument("--format", choices=["csv", "payload", "parquet"], default="csv")
        t.add_argument("--root")
        t.add_argument("--trees", type=int, default=100)
        t.add_argument("--depth", type=int, default=10)
        if name != "train":
            t.add_argument("--serving", required=True, help="registry of the models that serve each place")
    sub.choices["train"].add_argument("--location-id", help="single-place CSV (date + 7 measures): tag rows with this id")
    sub.choices["retrain"].add_argument("--places", required=True, help="location ids, comma-separated")
    for p in (sub.choices["train"], sub.choices["retrain"], sub.choices["tune"], sub.add_parser("evaluate"), sub.add_parser("forecast")):
        p.add_argument("--seq-kind", default="linear")
        p.add_argument("--seq-len", type=int, default=7)
    e = sub.choices["evaluate"]
    e.add_argument("--root", required=True)
    f = sub.choices["forecast"]
    source = f.add_mutually_exclusive_group(required=True)
    source.add_argument("--root")
    source.add_argument("--serving", help="registry: each place by the model that serves it")
    f.add_argument("--payload", required=True)
    f.add_argument("--stored", help="stored raw rows: forecast places without a feed from their last days")
    f.add_argument("--stored-format", choices=["csv", "payload", "parquet"], default="csv")
    f.add_argument("--multi-line", action="store_true")
    f.add_argument("--as-of", required=True)
    f.add_argument("--locations")
    f.add_argument("--stamp")
    f.add_argument("--out", required=True)
    args = ap.parse_args()
    {"train": train, "evaluate": evaluate, "forecast": forecast, "retrain": retrain, "tune": tune}[args.cmd](args)


if __name__ == "__main__":
    main()
