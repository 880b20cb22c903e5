"""The command line from raw rows to an export: registry, retrain and stored-data fallback."""

import json
import sys

import pytest
from pyspark.sql import functions as F

from stratus import __main__ as cli
from stratus.plans import jobs
from stratus.sources import files, payload
from test_edges import series


def run(monkeypatch, *args):
    monkeypatch.setattr(sys, "argv", ["stratus", *args])
    cli.main()


@pytest.fixture
def raw(spark, tmp_path):
    rows = series(spark, 150, loc="A").unionByName(series(spark, 150, loc="B"))
    files.write_raw_csv(rows, f"{tmp_path}/raw")
    days = payload.nest_daily(rows.where((F.col("location_id") == "A") & (F.dayofyear("date") > 110)), ["location_id"])
    stamp = F.lit("2020-06-01 00:00:00").cast("timestamp").alias("fetched_at")
    now = F.struct(F.lit(21.0).alias("temperature_2m"), F.lit(50.0).alias("relative_humidity_2m")).alias("current")
    days.select("location_id", stamp, now, "daily").write.json(f"{tmp_path}/payload")
    return str(tmp_path)


def test_serving_after_a_retrain_with_fallback(spark, raw, monkeypatch):
    small = ["--trees", "3", "--depth", "3"]
    serving = f"{raw}/serving"
    run(monkeypatch, "retrain", "--raw", f"{raw}/raw", "--places", "A,B", "--serving", serving, "--root", f"{raw}/first", *small)
    run(monkeypatch, "retrain", "--raw", f"{raw}/raw", "--places", "B", "--serving", serving, "--root", f"{raw}/second", *small)
    assert {r.location_id: r.root for r in jobs.serving_registry(spark, serving).collect()} == {"A": f"{raw}/first", "B": f"{raw}/second"}
    common = ["--payload", f"{raw}/payload", "--as-of", "2020-05-29", "--stored", f"{raw}/raw"]
    run(monkeypatch, "forecast", "--serving", serving, *common, "--out", f"{raw}/served")
    run(monkeypatch, "forecast", "--root", f"{raw}/first", *common, "--out", f"{raw}/plain")
    for out in ("served", "plain"):
        rows = {r.location_id: r for r in files.read_export(spark, f"{raw}/{out}").collect()}
        assert set(rows) == {"A", "B"} and all(r.temp_tomorrow is not None for r in rows.values())
        assert rows["A"].humidity == 50.0 and rows["B"].humidity != 0.0       # B's current block comes from storage
        assert spark.read.schema("location_id string").json(f"{raw}/{out}-rejects").count() == 0
    run(monkeypatch, "forecast", "--root", f"{raw}/first", *common[:4], "--out", f"{raw}/feed")
    assert [r.location_id for r in files.read_export(spark, f"{raw}/feed").collect()] == ["A"]


def test_two_fetches_give_one_document_per_place(spark, raw, monkeypatch):
    run(monkeypatch, "train", "--raw", f"{raw}/raw", "--root", f"{raw}/root", "--trees", "3", "--depth", "3")
    line = json.loads(spark.read.text(f"{raw}/payload").first().value)
    later = {**line, "fetched_at": "2020-06-02T00:00:00Z", "current": {"temperature_2m": 30.0, "relative_humidity_2m": 60.0}}
    spark.createDataFrame([(json.dumps(later),)], "value string").write.mode("append").text(f"{raw}/payload")
    run(monkeypatch, "forecast", "--root", f"{raw}/root", "--payload", f"{raw}/payload", "--as-of", "2020-05-29", "--out", f"{raw}/out")
    assert [(r.location_id, r.humidity) for r in files.read_export(spark, f"{raw}/out").collect()] == [("A", 60.0)]
