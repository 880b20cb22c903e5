"""Sequences, split assignment, model names and persistence."""

import pytest
from pyspark.sql import functions as F

from stratus.operators import features, sequences, split
from stratus.plans import models as M
from test_edges import series


def test_sequence_split_counts(spark):
    processed = features.engineer(series(spark, 80))          # 50 processed rows
    assert processed.count() == 50
    data, _ = M.sequence_dataset(processed, 7)
    counts = {r.seq_split: r.c for r in data.groupBy("seq_split").agg(F.count("*").alias("c")).collect()}
    assert counts == {"train": 34, "test": 10}
    s = split.with_split(processed)
    assert s.where(F.col("split") == "train").count() == 40


def test_no_train_test_overlap(spark):
    s = split.with_split(features.engineer(series(spark, 120)))
    tr = s.where(F.col("split") == "train").agg(F.max("date")).first()[0]
    te = s.where(F.col("split") == "test").agg(F.min("date")).first()[0]
    assert tr < te


@pytest.mark.parametrize("name", ["bi-lstm", "lstm", "gru", "transformer"])
def test_unknown_model_name_fails(name):
    with pytest.raises(ValueError):
        M.check_kind(name)


def test_latest_sequence_rejects_short_series(spark):
    ok, rejects = sequences.latest_sequence(series(spark, 5), "2030-01-01", 7)
    assert ok.count() == 0 and rejects.first().seq_rows == 5


def test_forest_fit_save_load_equal(spark, tmp_path):
    processed = features.engineer(series(spark, 120))
    s = split.with_split(processed)
    model = M.fit_forest(s, M.ForestParams(num_trees=5, max_depth=4))
    a = M.score_forest(model, s).orderBy("date").collect()
    M.save_pipeline(model, str(tmp_path / "forest"))
    b = M.score_forest(M.load_pipeline(str(tmp_path / "forest")), s).orderBy("date").collect()
    assert a == b and all(r.predicted == r.predicted for r in a)


def test_sequence_fit_scores_are_finite(spark):
    processed = features.engineer(series(spark, 120))
    data, stats = M.sequence_dataset(processed, 7)
    model = M.fit_sequence(data, "linear")
    preds = M.score_sequence(model, data, "seq_linear").collect()
    assert preds and all(abs(r.predicted) < 1e6 for r in preds)
    out, rejects = M.forecast_sequence(model, stats, series(spark, 120), "2030-01-01", "seq_linear")
    assert out.count() == 1 and rejects.count() == 0


def test_training_job_end_to_end(spark):
    from stratus.plans import jobs
    raw = series(spark, 150, loc="A").unionByName(series(spark, 150, loc="B"))
    res = jobs.train(spark, raw, forest=M.ForestParams(num_trees=5, max_depth=4))
    assert res.processed_rows == 240
    assert res.outputs["metrics"].count() == 4
    assert res.outputs["best_model"].count() == 2
    assert res.outputs["top_importances"].count() == 15


def test_retrain_selected_places(spark):
    from stratus.plans import jobs
    raw = (series(spark, 150, loc="A").unionByName(series(spark, 150, loc="B"))
           .unionByName(series(spark, 150, loc="C")))
    chosen = spark.createDataFrame([("A", "Place A"), ("C", "Place C")], "location_id string, name string")
    res = jobs.retrain_locations(spark, raw, chosen, forest=M.ForestParams(num_trees=3, max_depth=3))
    assert {r.location_id for r in res.outputs["metrics"].collect()} == {"A", "C"}
    assert jobs.active_locations(spark, res.root).count() == 2


def test_gbt_sequence_model_fits_and_forecasts(spark):
    processed = features.engineer(series(spark, 120))
    data, stats = M.sequence_dataset(processed, 5)
    model = M.fit_sequence(data, "GBT", maxIter=3, maxDepth=2)
    assert M.score_sequence(model, data, M.sequence_name("gbt")).count() == 18   # 90 rows, split 72
    out, _ = M.forecast_sequence(model, stats, series(spark, 120), "2030-01-01", "seq_gbt", 5)
    assert out.count() == 1


def test_tuning_scores_on_the_training_tail_and_picks_one(spark):
    processed = features.engineer(series(spark, 120))
    grid = [{"regParam": 0.0}, {"regParam": 10.0}]
    rows = M.tune_sequence(processed, seq_lens=(3, 5), grid=grid).collect()
    assert len(rows) == 4 and sum(r.chosen for r in rows) == 1
    best = min(rows, key=lambda r: r.rmse)
    assert best.chosen and all(r.rmse == r.rmse for r in rows)


def test_retrained_and_tuned_models_serve(spark):
    from stratus.plans import jobs
    from stratus.session import scratch_path
    raw = series(spark, 150, loc="A").unionByName(series(spark, 150, loc="B"))
    small = M.ForestParams(num_trees=3, max_depth=3)
    serving = scratch_path(spark, "t-serving")
    first = jobs.train(spark, raw, forest=small)
    jobs.register(spark, serving, first.root)
    again = jobs.retrain_locations(spark, raw, spark.createDataFrame([("B",)], "location_id string"), serving=serving, forest=small)
    roots = {r.location_id: r.root for r in jobs.serving_registry(spark, serving).collect()}
    assert roots == {"A": first.root, "B": again.root}
    forecasts, rejects = jobs.serve(spark, serving, raw, "2030-01-01")
    assert {r.location_id: r.root for r in forecasts.collect()} == roots and rejects.count() == 0
    tuned = jobs.tune(spark, raw, serving, seq_lens=(3,), forest=small)
    assert {r.root for r in jobs.serving_registry(spark, serving).collect()} == {tuned.root}


def test_sums_give_the_coefficients_and_errors_of_fits(spark):
    """One pass over the rows against a fit per grid point, several places with different spans."""
    from stratus.plans import moments
    raw = series(spark, 160, loc="A").unionByName(series(spark, 130, start="2020-02-01", loc="B").withColumn("temp_mean", F.col("temp_mean") * 3))
    processed = features.engineer(raw)
    grid = [{"regParam": r, "elasticNetParam": 0.0} for r in (0.01, 0.1, 1.0)]
    fits = {(r.seq_len, r.params): r for r in M.tune_sequence(processed, seq_lens=(2, 3), grid=grid).collect()}
    sums = {(r.seq_len, r.params): r for r in M.tune_linear(processed, seq_lens=(2, 3), reg_params=(0.01, 0.1, 1.0)).collect()}
    assert set(fits) == set(sums) and sum(r.chosen for r in sums.values()) == 1
    for k, r in fits.items():
        assert abs(r.rmse - sums[k].rmse) < 1e-6 * (1 + r.rmse) and r.chosen == sums[k].chosen
    data, _ = M.sequence_dataset(processed, 3)
    train = data.where("seq_split = 'train'")
    gram = moments.fold_moments(train, F.col("target_temp_s"), F.lit(1.0), F.lit(0))[0]
    for reg in (0.01, 1.0):
        model = M.sequence_estimator("linear", regParam=reg).fit(train)
        got = moments.solve(gram, reg)
        assert max(abs(a - b) for a, b in zip(got.coefficients, model.coefficients)) < 1e-8 and abs(got.intercept - model.intercept) < 1e-8


def test_sums_without_rows_or_variance(spark):
    from stratus.plans import moments
    from pyspark.ml.linalg import Vectors
    rows = spark.createDataFrame([(Vectors.dense([1.0, float(i)]), 2.0 * i) for i in range(5)], ["features", "y"])
    gram = moments.fold_moments(rows, F.col("y"), F.lit(1.0), F.lit(0))[0]
    got = moments.solve(gram, 0.0)
    assert abs(got.coefficients[0]) < 1e-12 and abs(got.coefficients[1] - 2) < 1e-9 and moments.squared_error(gram, got) < 1e-9
    assert moments.fold_moments(rows.limit(0), F.col("y"), F.lit(1.0), F.lit(0)) == {}
