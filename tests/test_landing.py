"""Landing of payload files: each file once, each place and time once, broken records kept apart."""

import json
import os

from pyspark.sql import functions as F

from stratus.session import scratch_path
from stratus.sources import files, payload
from stratus.streaming import landing, manifest

FIELDS = ["temperature_2m_max", "temperature_2m_min", "temperature_2m_mean", "relative_humidity_2m_mean",
          "precipitation_sum", "wind_speed_10m_max", "pressure_msl_mean"]


def daily(place, fetched, days, value=1.0):
    return {"location_id": place, "fetched_at": f"2024-01-{fetched:02d}T00:00:00Z",
            "daily": {"time": days, **{f: [value] * len(days) for f in FIELDS}}}


def put(folder, name, *docs):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs))


def test_second_landing_reads_new_files_and_touched_ranges(spark):
    src, root, ckpt = (scratch_path(spark, n) for n in ("t-land", "t-tables", "t-ckpt"))
    put(src, "a.json", daily("A", 2, ["2024-01-01", "2024-02-01"]), daily("B", 2, ["2024-01-01"]))
    assert landing.run(spark, src, root, ckpt, shares=2) == 2
    before = set(manifest.state(spark, root).folders["raw"])
    # A correction of one day, an older fetch of another, a new day.
    put(src, "b.json", daily("A", 3, ["2024-02-01"], 5.0), daily("A", 1, ["2024-02-01", "2024-02-02"], 9.0))
    assert landing.run(spark, src, root, ckpt, shares=2) == 2
    after = set(manifest.state(spark, root).folders["raw"])
    assert {f.split("/")[1] for f in before - after} == {f.split("/")[1] for f in after - before} and len(after - before) == 1
    rows = {(r.location_id, str(r.date)): r.temp_max for r in landing.table(spark, root, "raw").collect()}
    assert rows == {("A", "2024-01-01"): 1.0, ("A", "2024-02-01"): 5.0, ("A", "2024-02-02"): 9.0, ("B", "2024-01-01"): 1.0}
    assert landing.run(spark, src, root, ckpt, shares=2) == 0
    # The last landing runs again: nothing changes.
    lines = spark.read.text(os.path.join(src, "b.json")).select("value", F.col("_metadata.file_path").alias("path"))
    landing.merge(lines, 1, root, shares=2)
    assert landing.table(spark, root, "raw").count() == 4 and landing.table(spark, root, "rejects").count() == 0


def test_broken_records_are_kept_with_reason_and_text(spark):
    src, root, ckpt = (scratch_path(spark, n) for n in ("t-land", "t-tables", "t-ckpt"))
    bad = daily("A", 2, ["2024-01-01", "2024-13-77", "nonsense", None, "2024-01-05"])
    bad["daily"]["precipitation_sum"][4] = "wet"
    bad["daily"]["pressure_msl_mean"][0] = float("nan")
    hours = {"location_id": "H", "fetched_at": "2024-01-02T00:00:00Z",
             "hourly": {"time": ["2024-01-01T00:00", "bad"], "temperature_2m": [1.0, 2.0]}}
    put(src, "a.json", bad, '{"location_id": "C", "daily": {', {"daily": {"time": []}}, {"location_id": "D"}, "", hours,
        {"location_id": " ", "current": {"temperature_2m": 3.0}}, daily("E", 2, ["2024-01-01"]))
    landing.run(spark, src, root, ckpt)
    good = {(r.location_id, str(r.date), r.pressure) for r in landing.table(spark, root, "raw").collect()}
    assert good == {("A", "2024-01-01", None), ("E", "2024-01-01", 1.0)}
    assert [(r.location_id, str(r.ts)) for r in landing.table(spark, root, "hourly").collect()] == [("H", "2024-01-01 00:00:00")]
    rejects = landing.table(spark, root, "rejects").collect()
    assert sorted((r.location_id or "", r.reason) for r in rejects) == [
        ("", "malformed document"), ("", "no location"), ("A", "bad date"), ("A", "bad date"), ("A", "bad number: precipitation"),
        ("A", "no date"), ("D", "no daily block"), ("H", "bad ts")]
    assert all(r.path.endswith("/a.json") and r.raw for r in rejects)
    assert next(r.raw for r in rejects if r.reason == "malformed document") == '{"location_id": "C", "daily": {'


def test_csv_keeps_good_rows_of_a_broken_file(spark, tmp_path):
    head = "location_id,date,temp_max,temp_min,temp_mean,humidity,precipitation,wind_speed,pressure\n"
    (tmp_path / "a.csv").write_text(head + "A,2020-01-01,1,2,3,4,5,6,7\nA,2020-13-77,1,2,3,4,5,6,7\nA,2020-01-03,warm,2,3,4,5,6,x\n"
                                    "A,2020-01-04,1,2\n,2020-01-05,1,2,3,4,5,6,7\nA,2020-01-06,NaN,,3,4,5,6,7\nA,,1,2,3,4,5,6,7\n")
    rows = {str(r.date): (r.temp_max, r.temp_min) for r in files.read_raw_csv(spark, str(tmp_path)).collect()}
    assert rows == {"2020-01-01": (1.0, 2.0), "2020-01-06": (None, None)}
    got = sorted((r.reason, r.raw) for r in files.csv_rejects(spark, str(tmp_path)).collect())
    assert [r for r, _ in got] == ["bad date", "bad number: temp_max, pressure", "malformed row", "no date", "no location"]
    assert got[2][1] == "A,2020-01-04,1,2" and "2020-13-77" in got[0][1]
    assert files.csv_rejects(spark, str(tmp_path)).select("reason").distinct().count() == 5      # also with few columns read


def test_refetched_feed_gives_one_row_per_place_and_hour(spark, tmp_path):
    docs = []
    for fetched, t in ((2, 20.0), (3, 30.0), (1, 10.0)):
        docs.append({"location_id": "A", "fetched_at": f"2024-01-0{fetched}T00:00:00Z", "current": {"temperature_2m": t},
                     "hourly": {"time": ["2024-01-05T00:00", "2024-01-05T01:00"], "temperature_2m": [t, t]}})
    put(str(tmp_path), "a.json", *docs)
    docs = payload.read_forecast(spark, str(tmp_path))
    assert [r.temperature_2m for r in payload.current_obs(docs).collect()] == [30.0]
    assert [r.temperature_2m for r in payload.hourly_rows(docs).collect()] == [30.0, 30.0]
