"""Next-day temperature models on Spark MLlib.

Tabular model (M1-M3): one pooled random forest over every location's
processed rows.  Pooling keeps the number of fitted models constant as
locations grow; MLlib distributes tree induction over rows (per-level
sufficient statistics are aggregated across executors).  Local climate is
carried by the lag and rolling-mean features.

Sequence model (M6, M7): the recurrent network of the originating
application is re-aimed at MLlib regressors over flattened L x 11 windows of
per-location min-max-scaled features (same windows, split, scaling and
metrics).  ``linear`` uses the normal-equation solver (one distributed
aggregate of X'X); ``gbt`` uses gradient-boosted trees.

Long fits cut their lineage through the shared checkpoint folder
(``cacheNodeIds`` + ``checkpointInterval``), so a lost executor does not
replay the whole induction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.operators import scaling, sequences, split
from stratus.operators.forecast import latest_complete
from stratus.schemas import BASELINE_MODEL, DEFAULT_SEQ_LEN, SEQUENCE_FEATURES, TABULAR_FEATURES, TARGET
from stratus.session import materialize, shared_dir

SEQUENCE_KINDS = ("linear", "gbt")


@dataclass
class ForestParams:
    """100 trees, seed 42, every feature considered at each split (the
    originating defaults).  Those trees grow without a depth limit; MLlib
    caps depth at 30 and bins continuous features, so depth is a parameter
    (default 10) and quality is compared by RMSE, not by identical trees."""
    num_trees: int = 100
    max_depth: int = 10
    max_bins: int = 32
    seed: int = 42
    feature_subset: str = "all"


# ---------------------------------------------------------------- tabular forest
def forest_pipeline(params: ForestParams | None = None) -> Pipeline:
    p = params or ForestParams()
    assembler = VectorAssembler(inputCols=TABULAR_FEATURES, outputCol="features", handleInvalid="error")
    forest = RandomForestRegressor(
        featuresCol="features", labelCol=TARGET, predictionCol="predicted",
        numTrees=p.num_trees, maxDepth=p.max_depth, maxBins=p.max_bins, seed=p.seed,
        featureSubsetStrategy=p.feature_subset, subsamplingRate=1.0,
        cacheNodeIds=True, checkpointInterval=10)
    return Pipeline(stages=[assembler, forest])


def fit_forest(split_df: DataFrame, params: ForestParams | None = None) -> PipelineModel:
    """M1: fit on each location's training rows (pooled)."""
    shared_dir(split_df.sparkSession)   # checkpoint folder for node-id caching
    train = materialize(split_df.where(F.col("split") == "train").select(*TABULAR_FEATURES, TARGET),
                        "forest-train")
    return forest_pipeline(params).fit(train)


def score_forest(model: PipelineModel, split_df: DataFrame, name: str = BASELINE_MODEL,
                 which: str = "test") -> DataFrame:
    """M2: predictions as long rows (location_id, model, role, date, actual, predicted)."""
    rows = split_df if which == "all" else split_df.where(F.col("split") == which)
    return model.transform(rows).select(
        "location_id", F.lit(name).alias("model"), F.lit("baseline").alias("role"), "date",
        F.col(TARGET).alias("actual"), "predicted")


def importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """M3: (feature, importance).  The vector is model metadata of fixed
    length (40), not data, so building it on the driver is bounded."""
    vec = model.stages[-1].featureImportances.toArray().tolist()
    names = model.stages[0].getInputCols()
    return spark.createDataFrame(list(zip(names, [float(v) for v in vec])), "feature string, importance double")


# ---------------------------------------------------------------- sequence regressors
def check_kind(kind: str) -> str:
    """Q10: unknown model names fail loudly (no silent fallback)."""
    k = kind.lower()
    if k not in SEQUENCE_KINDS:
        raise ValueError(f"unknown sequence model {kind!r}; expected one of {SEQUENCE_KINDS}")
    return k


def sequence_name(kind: str) -> str:
    return f"seq_{check_kind(kind)}"


def sequence_dataset(processed: DataFrame, seq_len: int = DEFAULT_SEQ_LEN) -> tuple[DataFrame, DataFrame]:
    """W4 -> A5 -> M4 -> W5/W6: (sequence rows with vector features, scaler stats)."""
    s = split.with_split(processed)
    stats = scaling.fit_minmax(s)              # persisted scaler (M9); evaluated only when used
    seq = sequences.with_sequences(scaling.with_minmax(s), seq_len)
    data = seq.select("location_id", "date", "rn", "split_at", "seq_split", TARGET, f"{TARGET}_s",
                      f"{TARGET}_min", f"{TARGET}_max",
                      array_to_vector(sequences.flat_features("seq")).alias("features"))
    return data, stats


def sequence_estimator(kind: str = "linear", **params):
    """The regressor of a kind; ``params`` are MLlib's own parameter names."""
    k = check_kind(kind)
    common = dict(featuresCol="features", labelCol=f"{TARGET}_s", predictionCol="predicted_s")
    if k == "linear":
        return LinearRegression(**({"solver": "auto", "regParam": 0.0} | params | common))
    defaults = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "seed": 42}
    return GBTRegressor(**(defaults | params | common), cacheNodeIds=True, checkpointInterval=10)


def fit_sequence(data: DataFrame, kind: str = "linear", **params):
    """M6: fit on training sequences (those ending at or before the split)."""
    shared_dir(data.sparkSession)
    train = materialize(data.where(F.col("seq_split") == "train").select("features", f"{TARGET}_s"),
                        "sequence-train")
    return sequence_estimator(kind, **params).fit(train)


def score_sequence(model, data: DataFrame, name: str, which: str = "test") -> DataFrame:
    """M7 + M5: predictions back in degrees (inverse target scaling)."""
    rows = data if which == "all" else data.where(F.col("seq_split") == which)
    out = model.transform(rows)
    pred = scaling.unscale(F.col("predicted_s"), F.col(f"{TARGET}_min"), F.col(f"{TARGET}_max"))
    return out.select("location_id", F.lit(name).alias("model"), F.lit("sequence").alias("role"), "date",
                      F.col(TARGET).alias("actual"), pred.alias("predicted"))


# ---------------------------------------------------------------- live forecasts (M8, M9)
def forecast_forest(model: PipelineModel, rows: DataFrame, as_of: str, name: str = BASELINE_MODEL) -> DataFrame:
    """M8: latest complete feature row up to as_of -> next-day forecast."""
    latest = latest_complete(rows, as_of)
    return model.transform(latest).select(
        "location_id", F.lit(name).alias("model"), "latest_obs_date", "forecast_date",
        F.col("predicted").alias("forecast_temp"))


def forecast_sequence(model, stats: DataFrame, rows: DataFrame, as_of: str, name: str,
                      seq_len: int = DEFAULT_SEQ_LEN) -> tuple[DataFrame, DataFrame]:
    """M9: last L complete rows -> scale with stored stats -> predict -> unscale.

    Returns (forecasts, rejects); locations short of L rows are rejects.
    """
    ok, rejects = sequences.latest_sequence(rows, as_of, seq_len)
    joined = ok.join(stats, "location_id")
    scaled_rows = F.transform("seq", lambda r: F.array(*[
        scaling.scale(r[i], F.col(f"{c}_min"), F.col(f"{c}_max")) for i, c in enumerate(SEQUENCE_FEATURES)]))
    feats = joined.withColumn("features", array_to_vector(F.flatten(scaled_rows)))
    pred = scaling.unscale(F.col("predicted_s"), F.col(f"{TARGET}_min"), F.col(f"{TARGET}_max"))
    out = model.transform(feats).select(
        "location_id", F.lit(name).alias("model"), F.col("seq_end").alias("latest_obs_date"),
        F.date_add(F.col("seq_end"), 1).alias("forecast_date"), pred.alias("forecast_temp"))
    return out, rejects


# ---------------------------------------------------------------- tuning
GRIDS = {"linear": [{"regParam": r, "elasticNetParam": 0.0} for r in (0.0, 0.01, 0.1)],
         "gbt": [{"maxDepth": d, "maxIter": 20, "stepSize": s} for d in (3, 5) for s in (0.1, 0.3)]}
VALIDATION_SHARE = 0.2


def tune_sequence(processed: DataFrame, seq_lens=(3, 7, 14), kind: str = "linear",
                  grid: list[dict] | None = None, parallelism: int = 4) -> DataFrame:
    """Grid over window length x regressor parameters (``seq_len, kind, params, rmse, chosen``).

    Scored on the tail of each place's *training* rows; the test split stays unseen.
    Each window length builds its dataset once; its fits run side by side as Spark jobs
    (``parallelism`` at a time), and one aggregate scores all of them.
    """
    from multiprocessing.pool import ThreadPool
    grid = grid or GRIDS[check_kind(kind)]
    results = []
    for seq_len in seq_lens:
        data, _ = sequence_dataset(processed, seq_len)
        known = materialize(data.where(F.col("seq_split") == "train"), f"tuning-seq{seq_len}")
        tail = F.col("rn") > F.floor(F.col("split_at") * (1 - VALIDATION_SHARE))
        fit_rows, check_rows = known.where(~tail), known.where(tail)
        estimators = []
        for params in grid:
            est = sequence_estimator(kind)
            estimators.append(est.copy({est.getParam(k): v for k, v in params.items()}))
        with ThreadPool(parallelism) as pool:
            models = pool.map(lambda est: est.fit(fit_rows), estimators)
        scored = check_rows
        for i, model in enumerate(models):
            scored = model.copy({model.getParam("predictionCol"): f"p{i}"}).transform(scored)
        span = F.when(F.col(f"{TARGET}_max") > F.col(f"{TARGET}_min"),
                      F.col(f"{TARGET}_max") - F.col(f"{TARGET}_min")).otherwise(1.0)
        errors = scored.agg(*[F.sqrt(F.avg(F.pow((F.col(f"p{i}") - F.col(f"{TARGET}_s")) * span, 2))).alias(f"e{i}")
                              for i in range(len(models))]).first()
        results += [(seq_len, kind, str(sorted(p.items())), float(errors[i])) for i, p in enumerate(grid)]
    best = min(range(len(results)), key=lambda i: (results[i][3], i))
    rows = [(*r, i == best) for i, r in enumerate(results)]
    return processed.sparkSession.createDataFrame(
        rows, "seq_len int, kind string, params string, rmse double, chosen boolean")


def tune_linear(processed: DataFrame, seq_lens=(3, 7, 14), reg_params=(0.0, 0.001, 0.01, 0.1, 1.0)) -> DataFrame:
    """M10 for the linear kind from sufficient statistics: one pass per window length, however
    many strengths are tried.  Same columns, split and error as :func:`tune_sequence`."""
    from stratus.plans import moments
    results = []
    for seq_len in seq_lens:
        data, _ = sequence_dataset(processed, seq_len)
        known = data.where(F.col("seq_split") == "train")
        tail = F.col("rn") > F.floor(F.col("split_at") * (1 - VALIDATION_SHARE))
        span = F.when(F.col(f"{TARGET}_max") > F.col(f"{TARGET}_min"), F.col(f"{TARGET}_max") - F.col(f"{TARGET}_min")).otherwise(1.0)
        sums = moments.fold_moments(known.withColumn("tail", tail), F.col(f"{TARGET}_s"), F.when(F.col("tail"), span * span).otherwise(1.0),
                                    F.col("tail").cast("int"))
        counts = known.agg(F.count_if(tail)).first()[0]
        for reg in reg_params:
            error = (moments.squared_error(sums[1], moments.solve(sums[0], reg)) / counts) ** 0.5 if len(sums) == 2 else float("nan")
            results.append((seq_len, "linear", str([("elasticNetParam", 0.0), ("regParam", reg)]), error))
    best = min(range(len(results)), key=lambda i: (results[i][3], i))
    return processed.sparkSession.createDataFrame([(*r, i == best) for i, r in enumerate(results)],
                                                  "seq_len int, kind string, params string, rmse double, chosen boolean")


# ---------------------------------------------------------------- persistence
def save_pipeline(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
