"""Batch jobs built from the operators.

Stage outputs are written below the shared checkpoint folder and read back,
which cuts lineage between stages: a lost executor re-runs at most the
current stage, never the whole pipeline.
"""

from __future__ import annotations

import ast
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.operators import features, forecast, metrics, sequences, split
from stratus.plans import models as M
from stratus.schemas import DEFAULT_SEQ_LEN
from stratus.session import materialize, scratch_path
from stratus.sources import files


@dataclass
class TrainResult:
    root: str
    processed_rows: int
    outputs: dict[str, DataFrame] = field(default_factory=dict)


class PipelineStageError(RuntimeError):
    """A stage produced nothing usable; later stages are not run."""


def train(spark: SparkSession, raw: DataFrame, root: str | None = None,
          forest: M.ForestParams | None = None, seq_kind: str = "linear",
          seq_len: int = DEFAULT_SEQ_LEN, seq_params: dict | None = None) -> TrainResult:
    """Features -> fit forest -> fit sequence model -> evaluate; stop on failure."""
    M.check_kind(seq_kind)
    root = root or scratch_path(spark, "pipeline")
    processed_path = os.path.join(root, "processed")
    files.write_processed(features.engineer(raw), processed_path)
    processed = files.read_processed(spark, processed_path)
    n = processed.count()
    if n == 0:
        raise PipelineStageError("feature stage produced no complete rows")

    forest_model = M.fit_forest(split.with_split(processed), forest)
    M.save_pipeline(forest_model, os.path.join(root, "models", "forest"))

    sequences.sequence_rejects(split.with_split(processed), seq_len).write.mode("overwrite").parquet(
        os.path.join(root, "sequence_rejects"))
    data, stats = M.sequence_dataset(processed, seq_len)
    seq_model = M.fit_sequence(data, seq_kind, **(seq_params or {}))
    seq_model.write().overwrite().save(os.path.join(root, "models", M.sequence_name(seq_kind)))
    stats.write.mode("overwrite").parquet(os.path.join(root, "models", "scaler"))

    result = TrainResult(root, n)
    result.outputs = evaluate(spark, root, seq_kind, seq_len)
    return result


def evaluate(spark: SparkSession, root: str, seq_kind: str = "linear",
             seq_len: int = DEFAULT_SEQ_LEN) -> dict[str, DataFrame]:
    """Load stored models, score the test split, compare, pick the best,
    write the metrics CSV and best-model registry."""
    from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel
    processed = files.read_processed(spark, os.path.join(root, "processed"))
    forest_model = M.load_pipeline(os.path.join(root, "models", "forest"))
    loader = LinearRegressionModel if M.check_kind(seq_kind) == "linear" else GBTRegressionModel
    seq_model = loader.load(os.path.join(root, "models", M.sequence_name(seq_kind)))

    rf_pred = M.score_forest(forest_model, split.with_split(processed))
    data, _ = M.sequence_dataset(processed, seq_len)
    seq_pred = M.score_sequence(seq_model, data, M.sequence_name(seq_kind))
    predictions = rf_pred.unionByName(seq_pred)
    pred_path = os.path.join(root, "predictions")
    predictions.write.mode("overwrite").parquet(pred_path)
    predictions = spark.read.parquet(pred_path)

    table = metrics.metrics(predictions)
    best = metrics.best_model(table)
    files.write_metrics_csv(table, os.path.join(root, "metrics_csv"))
    best.write.mode("overwrite").parquet(os.path.join(root, "best_model"))
    return {
        "metrics": table,
        "best_model": best,
        "top_importances": metrics.top_importances(M.importances(spark, forest_model)),
        "last_120": metrics.last_days(metrics.aligned(predictions, "Random Forest", M.sequence_name(seq_kind))),
    }


REGISTRY = "location_id string, model string, rmse double, root string, seq_kind string, seq_len int, version long"


def register(spark: SparkSession, serving: str, result_root: str, seq_kind: str = "linear",
             seq_len: int = DEFAULT_SEQ_LEN) -> None:
    """Append a training root's best models to the serving registry; per place the newest version serves."""
    spark.createDataFrame([], REGISTRY).write.mode("ignore").parquet(serving)
    version = spark.read.schema(REGISTRY).parquet(serving).agg(F.max("version")).first()[0] or 0
    (spark.read.parquet(os.path.join(result_root, "best_model")).select("location_id", "model", "rmse")
     .withColumns({"root": F.lit(result_root), "seq_kind": F.lit(seq_kind), "seq_len": F.lit(seq_len),
                   "version": F.lit(version + 1).cast("long")})
     .write.mode("append").parquet(serving))


def serving_registry(spark: SparkSession, serving: str) -> DataFrame:
    """One row per place: the model that serves it and the root that holds it."""
    cols = ["model", "rmse", "root", "seq_kind", "seq_len", "version"]
    rows = spark.read.schema(REGISTRY).parquet(serving)
    return (rows.groupBy("location_id").agg(F.max_by(F.struct(*cols), "version").alias("v"))
            .select("location_id", *[F.col(f"v.{c}").alias(c) for c in cols]))


def serve(spark: SparkSession, serving: str, rows: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(forecasts, rejects): every place by its registered model.

    The loop runs over training roots (one per training run that still serves a place),
    not over places: each root forecasts all its places at once.
    """
    from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel
    registry = materialize(serving_registry(spark, serving), "serving")
    made = []
    for r in registry.select("root", "seq_kind", "seq_len").distinct().collect():
        mine = rows.join(registry.where(F.col("root") == r.root).select("location_id"), "location_id", "left_semi")
        forest = M.load_pipeline(os.path.join(r.root, "models", "forest"))
        loader = LinearRegressionModel if r.seq_kind == "linear" else GBTRegressionModel
        name = M.sequence_name(r.seq_kind)
        seq_fc, _ = M.forecast_sequence(loader.load(os.path.join(r.root, "models", name)),
                                        spark.read.parquet(os.path.join(r.root, "models", "scaler")), mine, as_of, name, r.seq_len)
        made.append(M.forecast_forest(forest, mine, as_of).unionByName(seq_fc).withColumn("root", F.lit(r.root)))
    if not made:
        raise PipelineStageError("no model is registered")
    every = made[0]
    for part in made[1:]:
        every = every.unionByName(part)
    every = materialize(every, "served")
    best = registry.select("location_id", F.col("model").alias("best_model"))
    chosen = every.join(registry.select("location_id", "model", "root"), ["location_id", "model", "root"])
    return chosen, forecast.forecast_rejects(every, best)


def retrain_locations(spark: SparkSession, raw: DataFrame, chosen: DataFrame, root: str | None = None,
                      serving: str | None = None, **kwargs) -> TrainResult:
    """The training job restricted to chosen places (a semi join, not a
    driver-side list); with ``serving`` the new models take over those places."""
    subset = raw.join(chosen.select("location_id"), "location_id", "left_semi")
    result = train(spark, subset, root, **kwargs)
    chosen.write.mode("overwrite").parquet(os.path.join(result.root, "active_locations"))
    if serving:
        register(spark, serving, result.root, kwargs.get("seq_kind", "linear"), kwargs.get("seq_len", DEFAULT_SEQ_LEN))
    return result


def tune(spark: SparkSession, raw: DataFrame, serving: str, seq_lens=(3, 7, 14), kind: str = "linear",
         **kwargs) -> TrainResult:
    """M10 to serving: pick the window and parameters on the validation tail, refit the winner, register it."""
    processed = materialize(features.engineer(raw), "tuning-rows")
    won = M.tune_sequence(processed, seq_lens, kind).where("chosen").first()
    result = train(spark, raw, seq_kind=kind, seq_len=won.seq_len, seq_params=dict(ast.literal_eval(won.params)), **kwargs)
    register(spark, serving, result.root, kind, won.seq_len)
    return result


def active_locations(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, "active_locations"))


__all__ = ["train", "evaluate", "retrain_locations", "active_locations", "register", "serving_registry", "serve", "tune",
           "PipelineStageError"]
