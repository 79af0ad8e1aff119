"""The batch flow from files to reports, and its refusals."""

import json

import pytest
from pyspark.sql import functions as F

from wearcast.config import CORE_SENSORS, MODEL_PARAMS, Thresholds
from wearcast.plans import jobs, model_store
from wearcast.sources.sinks import read_by_day


@pytest.fixture(scope="module")
def readings(spark):
    """Two belts, three sensors, 26 hours, one reading each five minutes."""
    t = F.timestamp_seconds(F.lit(1_767_225_600) + F.col("id") * 300)
    rows = spark.range(312).select(F.explode(F.array(F.lit("b1"), F.lit("b2"))).alias("belt_id"), F.col("id")).select(
        "belt_id", F.explode(F.array(*map(F.lit, CORE_SENSORS))).alias("sensorid"), t.alias("ts"), "id")
    v = F.col("id") % 40 + F.when(F.col("sensorid") == CORE_SENSORS[0], 20.0).otherwise(260.0) + F.when((F.col("belt_id") == "b2") & (F.col("id") > 200), F.col("id") / 4).otherwise(0.0)
    return rows.select("belt_id", "sensorid", "ts", v.alias("avg_value"), *[F.lit(None).cast("double").alias(c) for c in ("min_value", "max_value", "std_deviation")],
                       (F.col("id") * 8 + F.abs(F.hash("belt_id", "sensorid")) % 8).alias("ingest_seq")).cache()


def test_config_files(spark, tmp_path):
    th, belts, model = (str(tmp_path / f"{n}.json") for n in ("th", "belts", "model"))
    (tmp_path / "th.json").write_text(json.dumps({"baseline_values": {"baseline_rul_days": 1234}}))
    (tmp_path / "belts.json").write_text(json.dumps([{"belt_id": "b1", "install_date": "2025-01-01", "replace_date": "2028-01-01"}, {"belt_id": 2, "installation_date": "2025-01-01", "replace_date": "2026-06-01"}]))
    (tmp_path / "model.json").write_text(json.dumps({"n_estimators": 7, "features": [f"{CORE_SENSORS[0]}_avg"], "fail_on_missing_features": False}))
    assert jobs.thresholds_from(spark, th).baseline_rul_days == 1234 and jobs.thresholds_from(spark, str(tmp_path / "no.json")) == Thresholds()
    assert [b.belt_id for b in jobs.belts_of(spark, belts)] == ["b1", "belt-2"]
    params, names, strict = jobs.model_settings(spark, model)
    assert params == {**MODEL_PARAMS, "n_estimators": 7} and len(names) == 1 and "/" not in names[0] and not strict
    assert jobs.model_settings(spark, None) == (MODEL_PARAMS, None, True)
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        jobs.thresholds_from(spark, str(tmp_path / "bad.json"))
    with pytest.raises(ValueError, match="no belt metadata"):
        jobs.belts_of(spark, str(tmp_path / "none.json"))


def test_unfit_input_is_refused(spark, readings, tmp_path):
    out = str(tmp_path / "c")
    with pytest.raises(ValueError, match="no reading"):
        jobs.clean_to(readings.where("sensorid = 'none'"), out, Thresholds())
    with pytest.raises(ValueError, match="out of range"):
        jobs.clean_to(readings, out, Thresholds(ranges={s: (1e6, None) for s in CORE_SENSORS}))
    with pytest.raises(ValueError, match="b2"):
        jobs.clean_to(readings.where(f"belt_id = 'b1' or sensorid <> '{CORE_SENSORS[1]}'"), out, Thresholds())
    assert jobs.clean_to(readings.unionByName(readings), out, Thresholds()).count() == readings.count()


def test_batch_flow(spark, readings, tmp_path):
    (tmp_path / "belts.json").write_text(json.dumps([{"belt_id": b, "install_date": "2025-01-01", "replace_date": "2028-01-01"} for b in ("b1", "b2")]))
    belts, out, store = jobs.belts_of(spark, str(tmp_path / "belts.json")), str(tmp_path / "out"), str(tmp_path / "store")
    small = {"n_estimators": 4, "max_depth": 4, "cv_n_estimators": 10, "cv_folds": 2}
    safe = jobs.run_batch(readings, f"{out}-safe", belts, store=store, last_rows=50).collect()
    assert {r.status for r in safe} == {"safe_mode_calendar"} and read_by_day(spark, f"{out}-safe/predictions").count() == 100
    summary = jobs.run_batch(readings, out, belts, store=store, train=True, params=small).collect()
    assert {r.belt_id: r.status for r in summary} == {"b1": "ok", "b2": "ok"} and model_store.versions(spark, store) == [1]
    p = read_by_day(spark, f"{out}/predictions")
    assert p.count() == read_by_day(spark, f"{out}/features").count() > 3000
    assert "@timestamp" in p.columns and f"{CORE_SENSORS[0]}_1h_mean" in p.columns and p.where("final_health is null").count() == 0
    assert spark.read.parquet(f"{store}/v1/importances").count() == 40
    metrics = {r.name: float(r.value) for r in spark.read.option("header", True).csv(f"{out}/metrics").collect()}
    assert metrics["n_features"] == 40 and "health_test_mae" in metrics
    assert spark.read.option("header", True).csv(f"{out}/summary").count() == 2 == spark.read.option("header", True).csv(f"{out}/quality").count()
    feats = read_by_day(spark, f"{out}/features")
    (tmp_path / "store" / "v2").mkdir()
    (tmp_path / "store" / "v2" / "_READY").touch()
    broken = jobs.scored(feats, store, Thresholds())
    assert {r.prediction_status for r in broken.select("prediction_status").distinct().collect()} == {"fallback_prediction_failed"}
