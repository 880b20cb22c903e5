"""Streaming feature refresh equals the batch feature table, in or out of order."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from stratus.operators import features, forecast, sequences
from stratus.session import scratch_path
from stratus.streaming import alerts as stream_alerts
from stratus.streaming import features as stream_features
from stratus.streaming import manifest
from test_edges import series


def _land_in_order(spark, df, chunks):
    src = scratch_path(spark, "t-src")
    for lo, hi in chunks:   # one write per chunk, in arrival order
        df.where((F.col("date") >= F.lit(lo)) & (F.col("date") < F.lit(hi))).coalesce(1) \
          .write.mode("append").parquet(src)
    return src


def _run(spark, src):
    root, ckpt = scratch_path(spark, "t-store"), scratch_path(spark, "t-ckpt")
    stream_features.run(spark, src, root, ckpt, max_files_per_trigger=1)
    return stream_features.feature_view(spark, root)


def _same(a, b):
    cols = sorted(a.columns)
    return sorted(a.select(cols).collect()) == sorted(b.select(cols).collect())


def test_in_order_arrival_matches_batch(spark):
    raw = series(spark, 400, loc="A").unionByName(series(spark, 250, start="2020-03-01", loc="B", gaps=(40, 41, 90)))
    src = _land_in_order(spark, raw, [("2019-01-01", "2020-04-01"), ("2020-04-01", "2020-09-01"),
                                      ("2020-09-01", "2020-09-02"), ("2020-09-02", "2022-01-01")])
    assert _same(_run(spark, src), features.engineer(raw))


def test_late_rows_are_recomputed(spark):
    raw = series(spark, 200, loc="A")
    src = _land_in_order(spark, raw, [("2020-03-01", "2021-01-01"), ("2020-01-01", "2020-03-01")])
    assert _same(_run(spark, src), features.engineer(raw))


def test_resent_row_newest_wins(spark):
    raw = series(spark, 120, loc="A")
    src = _land_in_order(spark, raw, [("2020-01-01", "2021-01-01")])
    fix = raw.where(F.col("date") == F.lit(dt.date(2020, 3, 1))).withColumn("temp_max", F.lit(77.0))
    fix.coalesce(1).write.mode("append").parquet(src)
    expected = features.engineer(raw.where(F.col("date") != F.lit(dt.date(2020, 3, 1))).unionByName(fix))
    assert _same(_run(spark, src), expected)


def test_alert_stream_drops_redeliveries(spark):
    rows = [(1, "A", "2024-01-01 00:00:00", 40.0, 10.0, 25.0, 1000.0, 0.0)] * 30 + [
        (i, "A", "2024-01-01 01:00:00", 20.0, 10.0, 5.0, 1010.0, 0.0) for i in range(2, 12)]
    obs = spark.createDataFrame(rows, "event_id long, location_id string, ts string, temperature_2m double, "
                                "relative_humidity_2m double, wind_speed_10m double, pressure_msl double, "
                                "precipitation double").withColumn("ts", F.col("ts").cast("timestamp"))
    src, sink, ckpt = (scratch_path(spark, n) for n in ("t-obs", "t-alerts", "t-ack"))
    obs.repartition(5).write.parquet(src)
    forecasts = spark.createDataFrame([], "location_id string, forecast_temp double")
    stream_alerts.run(spark, src, forecasts, sink, ckpt)
    out = stream_alerts.scored_observations(spark, sink)
    assert out.count() == 11
    first = out.where("event_id = 1").first()
    assert first.alert_level == "SEVERE HEAT WARNING" and first.wind_caution


def test_late_observation_is_scored_and_listed(spark):
    def land(rows, src):
        spark.createDataFrame([(i, "A", ts, 20.0, 10.0, 5.0, 1010.0, 0.0) for i, ts in rows],
                              "event_id long, location_id string, ts string, temperature_2m double, relative_humidity_2m double, "
                              "wind_speed_10m double, pressure_msl double, precipitation double").withColumn(
            "ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
    src, sink, ckpt = (scratch_path(spark, n) for n in ("t-obs", "t-alerts", "t-ack"))
    forecasts = spark.createDataFrame([], "location_id string, forecast_temp double")
    for rows in ([(1, "2024-01-02 00:00:00")], [(2, "2024-01-02 01:00:00"), (1, "2024-01-02 00:00:00")],
                 [(3, "2024-01-01 00:00:00"), (3, "2024-01-01 00:00:00"), (4, "2024-01-02 00:30:00")]):
        land(rows, src)
        stream_alerts.run(spark, src, forecasts, sink, ckpt)
    assert sorted(r.event_id for r in stream_alerts.scored_observations(spark, sink).collect()) == [1, 2, 3, 4]
    assert [r.event_id for r in stream_alerts.late_observations(spark, sink).collect()] == [3]


def test_resent_null_supersedes_and_compaction_keeps_the_view(spark):
    raw = series(spark, 150, loc="A")
    src = _land_in_order(spark, raw, [("2020-01-01", "2020-03-01"), ("2020-03-01", "2021-01-01")])
    bad = raw.where(F.col("date") == F.lit(dt.date(2020, 3, 20))).withColumn("pressure", F.lit(None).cast("double"))
    bad.coalesce(1).write.mode("append").parquet(src)
    root, ckpt = scratch_path(spark, "t-store"), scratch_path(spark, "t-ckpt")
    stream_features.run(spark, src, root, ckpt, max_files_per_trigger=1, compact_every=2)
    want = features.engineer(raw.where(F.col("date") != F.lit(dt.date(2020, 3, 20))).unionByName(bad))
    assert _same(stream_features.feature_view(spark, root), want)
    stream_features.compact(spark, root)
    assert _same(stream_features.feature_view(spark, root), want)
    rows = spark.read.parquet(stream_features._folder(spark, root, "features"))
    assert rows.count() == rows.select("location_id", "date").distinct().count()


def _uncommit(ckpt):
    """What a driver leaves that stops after its last batch's work: everything but Spark's commit."""
    commits = os.path.join(ckpt, "commits")
    last = max((n for n in os.listdir(commits) if n.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        if os.path.exists(os.path.join(commits, name)):
            os.remove(os.path.join(commits, name))
    return int(last)


def test_replay_around_a_compaction_leaves_the_view(spark, monkeypatch):
    raw = series(spark, 150, loc="A").unionByName(series(spark, 60, loc="B"))
    src = _land_in_order(spark, raw, [("2020-01-01", "2020-03-01"), ("2020-03-01", "2021-01-01")])
    root, ckpt = scratch_path(spark, "t-store"), scratch_path(spark, "t-ckpt")

    def run():
        stream_features.run(spark, src, root, ckpt, compact_every=1)
        return _same(stream_features.feature_view(spark, root), features.engineer(raw))

    assert run()
    assert _uncommit(ckpt) == 1 and run()                   # stopped after the compaction
    _uncommit(ckpt)
    real = manifest.commit

    def stop_at_the_swap(spark, root, batch_id, folders, note=None):
        if all(len(f) == 1 for f in folders.values()):
            raise RuntimeError("stopped")
        real(spark, root, batch_id, folders, note)
    monkeypatch.setattr(manifest, "commit", stop_at_the_swap)
    with pytest.raises(Exception, match="stopped"):          # stopped between writing and swapping
        run()
    assert _same(stream_features.feature_view(spark, root), features.engineer(raw))
    monkeypatch.setattr(manifest, "commit", real)
    assert run()
    # Of earlier batches only the version is kept that a replay of the last one starts from.
    kept = spark.read.schema(manifest.VERSION).json(f"{root}/versions").collect()
    assert [r.batch_id for r in kept].count(0) == 1 and {r.batch_id for r in kept} == {0, 1}
    assert {f for r in kept for f in r.folders["raw"]} <= set(os.listdir(f"{root}/raw"))
    stream_features.compact(spark, root)
    assert run() and len(manifest.state(spark, root).folders["features"]) == 1


def _observations(spark, rows, src):
    schema = ("event_id long, location_id string, ts string, temperature_2m double, relative_humidity_2m double, "
              "wind_speed_10m double, pressure_msl double, precipitation double")
    (spark.createDataFrame([(i, "A", ts, t, 10.0, 5.0, 1010.0, 0.0) for i, ts, t in rows], schema)
     .withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src))


def test_redelivery_with_another_day_is_one_event(spark):
    src, sink, ckpt = (scratch_path(spark, n) for n in ("t-obs", "t-alerts", "t-ack"))
    forecasts = spark.createDataFrame([], "location_id string, forecast_temp double")

    def rows(**kwargs):
        stream_alerts.run(spark, src, forecasts, sink, ckpt, **kwargs)
        return sorted((r.event_id, str(r.ts)) for r in stream_alerts.scored_observations(spark, sink).collect())

    _observations(spark, [(1, "2024-01-01 23:59:00", 20.0)], src)
    assert rows() == [(1, "2024-01-01 23:59:00")]
    _observations(spark, [(1, "2024-01-02 00:01:00", 20.0), (2, "2024-01-02 00:02:00", 40.0)], src)
    want = [(1, "2024-01-01 23:59:00"), (2, "2024-01-02 00:02:00")]
    assert rows() == want
    _uncommit(ckpt)
    assert rows() == want                                    # the last batch runs again
    for day in range(3, 9):
        _observations(spark, [(1, f"2024-01-0{day} 00:00:00", 20.0), (day, f"2024-01-0{day} 00:00:00", 20.0)], src)
        got = rows(compact_every=2)
    assert [i for i, _ in got] == list(range(1, 9)) and len(manifest.state(spark, sink).folders["alerts"]) <= 2
    assert not any(r.late for r in stream_alerts.scored_observations(spark, sink).collect())
    _uncommit(ckpt)
    assert rows(compact_every=2) == got


def test_ids_are_compared_without_reading_the_sink(spark):
    """The plan of a batch has one shuffle (ids) before the state and no scan of stored rows."""
    obs = spark.createDataFrame([], stream_alerts.OBSERVATION)
    plan = stream_alerts.first_deliveries(obs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(event_id") == 1 and "partial_min" in plan


def _live_equals_batch(spark, root, raw):
    got, want = stream_features.live_latest(spark, root), forecast.latest_complete(raw, "2100-01-01")
    assert _same(got.select(want.columns), want)
    seqs, _ = sequences.latest_sequence(raw, "2100-01-01", 7)
    assert _same(stream_features.live_sequence(spark, root, 7).select(seqs.columns), seqs)


def test_live_state_equals_the_whole_history(spark):
    """In order, late, corrected, made incomplete, short places: never different from reading all days."""
    raw = series(spark, 120, loc="A").unionByName(series(spark, 45, loc="B")).unionByName(series(spark, 5, loc="C"))
    day = F.dayofyear("date")
    missing = raw.where((F.col("location_id") == "A") & (day >= 105)).withColumn("pressure", F.lit(None).cast("double"))
    src, root, ckpt = (scratch_path(spark, n) for n in ("t-src", "t-store", "t-ckpt"))
    held = (F.col("location_id") == "B") & day.between(20, 24)
    stored = []
    for part in (raw.where(~held & (day <= 60)), raw.where(~held & (day > 60)), raw.where(held), missing):
        part.coalesce(1).write.mode("append").parquet(src)
        stored.append(part)
        stream_features.run(spark, src, root, ckpt, compact_every=3)
        now = stored[0]
        for more in stored[1:]:
            now = now.join(more.select("location_id", "date"), ["location_id", "date"], "left_anti").unionByName(more)
        _live_equals_batch(spark, root, now)
    # The latest complete row of A was undone and is an older one now; its last complete days as well.
    latest = {r.location_id: r.date.timetuple().tm_yday for r in stream_features.live_latest(spark, root).collect()}
    assert latest == {"A": 104, "B": 45}
    _uncommit(ckpt)
    stream_features.run(spark, src, root, ckpt, compact_every=3)
    _live_equals_batch(spark, root, now)
    scanned = stream_features.live_latest(spark, root).inputFiles()
    assert scanned and all("/live/" in f for f in scanned)
