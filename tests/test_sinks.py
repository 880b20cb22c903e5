"""Sinks and scans keep schemas and values (S5, S6, S10, S11, payload round trip)."""

from pyspark.sql import functions as F

from stratus.schemas import RAW_ORDER
from stratus.session import scratch_path
from stratus.sources import files, payload
from stratus.sources import fixtures as fx

from conftest import SF_SMALL


def _rows(df, cols):
    return sorted(df.select(*cols).collect())


def test_payload_round_trip_is_lossless(spark):
    rows = fx.payload_source_rows(spark, SF_SMALL)
    back = payload.dedupe_daily(payload.daily_rows(fx.forecast_payloads(spark, SF_SMALL), with_code=True))
    assert {r.location_id for r in back.where("NOT has_codes").collect()} == {fx.NO_CODES}
    cols = ["location_id", "date", *RAW_ORDER, "weather_code"]
    assert _rows(back, cols) == _rows(rows, cols)


def test_raw_csv_round_trip(spark):
    raw = fx.raw_daily(spark, SF_SMALL)
    path = scratch_path(spark, "t-csv")
    files.write_raw_csv(raw, path)
    back = files.read_raw_csv(spark, path)
    assert dict(back.dtypes)["date"] == "date"
    assert _rows(back, raw.columns) == _rows(raw, raw.columns)


def test_processed_read_prunes_to_one_location(spark):
    from stratus.operators.features import engineer
    df = engineer(fx.raw_daily(spark, SF_SMALL))
    path = scratch_path(spark, "t-processed")
    files.write_processed(df, path)
    one = files.read_processed(spark, path, "AFRICA")
    assert one.select("location_id").distinct().collect() == [("AFRICA",)]
    assert one.count() == df.where(F.col("location_id") == "AFRICA").count()


def test_export_document_has_the_thirteen_fields(spark):
    import __spark_entry__ as E
    doc = E.queries()["forecast_export"](spark, SF_SMALL)
    assert doc.columns == ["location_id"] + files.EXPORT_FIELDS and len(files.EXPORT_FIELDS) == 13
    assert doc.where(F.col("biometeorological_alert").isNull()).count() == 0


def test_metrics_csv_header(spark):
    import __spark_entry__ as E
    path = scratch_path(spark, "t-metrics")
    files.write_metrics_csv(E.queries()["model_metrics"](spark, SF_SMALL), path)
    header = spark.read.text(path).first()[0]
    assert header == "location_id,Model,Test RMSE (°C),Test MAE (°C)"


def test_processed_csv_round_trip(spark):
    from stratus.operators.features import engineer
    df = engineer(fx.raw_daily(spark, SF_SMALL))
    path = scratch_path(spark, "t-processed-csv")
    files.write_processed_csv(df, path)
    back = files.read_processed_csv(spark, path)
    assert dict(back.dtypes)["month"] == "int" and back.count() == df.count()
    assert _rows(back, ["location_id", "date", "temp_mean_roll_mean_30", "sin_day"]) == \
        _rows(df, ["location_id", "date", "temp_mean_roll_mean_30", "sin_day"])


def test_single_place_metrics_csv(spark, tmp_path):
    p = tmp_path / "metrics_comparison.csv"
    p.write_text("Model,Test RMSE (°C),Test MAE (°C)\nRandom Forest (Baseline),0.8639883888751697,0.6581250000000006\n")
    r = files.read_metrics_csv(spark, str(p), location_id="here").first()
    assert (r.location_id, r.model, r.rmse) == ("here", "Random Forest (Baseline)", 0.8639883888751697)


def test_locations_table_round_trip(spark):
    locs = fx.locations(spark, SF_SMALL)
    path = scratch_path(spark, "t-locs")
    files.write_locations(locs, path)
    assert _rows(files.read_locations(spark, path), locs.columns) == _rows(locs, locs.columns)


def test_shared_dir_comes_from_the_session(spark):
    from stratus.session import shared_dir
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
