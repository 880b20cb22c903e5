"""Model comparison over predictions.

Predictions are long rows (location_id, model, role, date, actual, predicted)
so every model is compared by the same grouped aggregate (partial aggregation
before the shuffle; output size = locations x models).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratus.schemas import PLOT_DAYS, TOP_IMPORTANCES


def metrics(predictions: DataFrame) -> DataFrame:
    """A1-A3: RMSE, MAE and row count per (location, model)."""
    err = F.col("actual") - F.col("predicted")
    return (predictions.groupBy("location_id", "model", "role")
            .agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
                 F.count(F.lit(1)).alias("n")))


def best_model(metric_rows: DataFrame) -> DataFrame:
    """A4: lowest RMSE per location; on a tie the sequence model wins."""
    tie = F.when(F.col("role") == "sequence", 0).otherwise(1)
    pick = F.min_by(F.struct("model", "rmse"), F.struct("rmse", tie.alias("tie")))
    return (metric_rows.groupBy("location_id").agg(pick.alias("_b"))
            .select("location_id", F.col("_b.model").alias("model"), F.col("_b.rmse").alias("rmse")))


def aligned(predictions: DataFrame, baseline: str, sequence: str) -> DataFrame:
    """Actual with both models' predictions on (location_id, date).

    Inner-join semantics (a date needs both models) as one conditional
    aggregate over the long predictions: a single exchange on the key with
    map-side combining, instead of a self-join scanning the source twice.
    """
    is_a, is_b = F.col("model") == baseline, F.col("model") == sequence
    return (predictions.where(is_a | is_b)
            .groupBy("location_id", "date")
            .agg(F.max(F.when(is_a, F.col("actual"))).alias("actual"),
                 F.max(F.when(is_a, F.col("predicted"))).alias("baseline_pred"),
                 F.max(F.when(is_b, F.col("predicted"))).alias("sequence_pred"),
                 F.count_if(is_a).alias("_na"), F.count_if(is_b).alias("_nb"))
            .where((F.col("_na") > 0) & (F.col("_nb") > 0)).drop("_na", "_nb"))


def last_days(df: DataFrame, days: int = PLOT_DAYS) -> DataFrame:
    """The last ``days`` rows per location."""
    w = Window.partitionBy("location_id").orderBy(F.col("date").desc())
    return df.withColumn("_rb", F.row_number().over(w)).where(F.col("_rb") <= days).drop("_rb")


def top_importances(importances: DataFrame, k: int = TOP_IMPORTANCES) -> DataFrame:
    """K1: top-k features by importance (TakeOrderedAndProject; k is the feature)."""
    return importances.orderBy(F.col("importance").desc(), F.col("feature")).limit(k)
