"""Cases that the driver's tables do not hold: belts without critical rows or
metadata, infinite readings, several CSV files, folds over repeated minutes."""

import math

import pytest
from pyspark.sql import functions as F

from wearcast.config import FIXTURE_BELTS, Thresholds
from wearcast.operators.clean import dedup_keep_last
from wearcast.operators.rolling import Spec, rolling_block
from wearcast.plans import features as FE
from wearcast.plans import training as TR
from wearcast.sources.readings import read_sensor_csv


def labelled(spark, n, critical, belt="b"):
    return spark.range(n).select(F.lit(belt).alias("belt_id"), F.col("id").alias("mi"), (F.col("id") < critical).cast("int").alias("is_critical_label"),
                                 F.lit(0.5).alias("degradation_index"), F.lit(0).alias("condition_state_code"))


def test_folds_of_the_upsampled_set(spark):
    up = TR.upsample(labelled(spark, 144_000, 8_790))
    got = {(r.fold, r.part): r.n_rows for r in TR.cv_fold_rows(up).collect()}
    assert got == {(1, "train"): 50_706, (2, "train"): 101_409, (3, "train"): 152_112,
                   (1, "validation"): 50_703, (2, "validation"): 50_703, (3, "validation"): 50_703}


def test_upsampling_leaves_healthy_belts(spark):
    rows = labelled(spark, 100, 10, "worn").unionByName(labelled(spark, 40, 0, "healthy")).unionByName(labelled(spark, 7, 7, "broken"))
    for up in (TR.upsample(rows), TR.upsample(TR.with_weights(rows), mode="weights")):
        assert {r.belt_id: r.c for r in up.groupBy("belt_id").agg(F.count("*").alias("c")).collect()} == {
            "worn": 135 if "weight" not in up.columns else 100, "healthy": 40, "broken": 7}
    w = TR.upsample(TR.with_weights(rows), mode="weights").where("belt_id = 'worn' and is_critical_label = 1").agg(F.sum("weight")).first()[0]
    assert w == pytest.approx(45 * 15 * 1.5)


def test_short_belts_are_not_cross_validated(spark):
    assert TR.cv_fold_rows(labelled(spark, 29, 3)).count() == 0


def test_belts_without_metadata_fail(spark):
    df = spark.createDataFrame([("stranger", 0.1, 0.0, 0.0)], "belt_id string, degradation_index double, warning_event_count_24h double, critical_event_count_24h double")
    df = df.withColumn("ts", F.to_timestamp(F.lit("2024-01-01")))
    with pytest.raises(Exception, match="without installation"):
        FE.target_features(df, FE.belts_table(spark, FIXTURE_BELTS), Thresholds()).collect()
    with pytest.raises(ValueError, match="metadata"):
        FE.belts_table(spark, None)


def test_one_infinite_reading_is_a_missing_one(spark):
    df = spark.range(10).select(F.lit("b").alias("belt_id"), F.col("id").alias("mi"), F.when(F.col("id") == 3, float("inf")).otherwise(F.col("id").cast("double")).alias("v"))
    got = rolling_block(df, ["belt_id"], "mi", 4, [Spec("w", "v")]).orderBy("mi").collect()
    assert [r.w_n for r in got] == [1, 2, 3, 3, 3, 3, 3, 4, 4, 4]
    assert all(math.isfinite(x) for r in got for x in (r.w_mean, r.w_m2, r.w_min, r.w_max)) and got[6].w_mean == pytest.approx(5.0)


def test_last_reading_wins_across_files(spark, tmp_path):
    head = "belt_id,sensorid,@timestamp,avg_value"
    line = "b1,ultrasonic_boot/elongation,2026-01-01T00:00:00Z,"
    (tmp_path / "a.csv").write_text("\n".join([head, line + "1"]))
    (tmp_path / "b.csv").write_text("\n".join([head, *[line + str(i) for i in range(2, 2000)]]))
    assert [r.avg_value for r in dedup_keep_last(read_sensor_csv(spark, str(tmp_path))).collect()] == [1999.0]


def test_saved_model_to_scores(spark, tmp_path):
    from wearcast.plans import model_scoring as MS

    n, feats = 200, ["x1", "x2"]
    cols = ["degradation_index", "warning_count", "critical_count", "current_volatility_6h", "temp_variability_12h", "elong_trend_6h"]
    df = spark.range(n).select(F.col("id").alias("mi"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("belt_id"),
                               F.col("id").cast("double").alias("x1"), F.sin("id").alias("x2"), F.lit(1.0).alias("weight"),
                               (100 - F.col("id") / 4).alias("target_health"), (2000.0 - F.col("id")).alias("target_rul_days"),
                               F.lit(900.0).alias("calendar_rul_days"), *[F.lit(0.1).alias(c) for c in cols])
    df = df.withColumn("mi", F.floor(F.col("mi") / 2))
    pair = TR.fit_pair(df, feats, {"n_estimators": 4, "max_depth": 4, "min_samples_leaf": 1, "random_state": 1})
    TR.save_models(*pair, str(tmp_path / "m"), feats, {})
    models = TR.load_models(str(tmp_path / "m"))
    good = MS.score_table(df, models)
    assert {r.prediction_status for r in good.collect()} == {"ok"} and good.count() == n
    assert all(0 <= r.final_health <= 100 and abs(r.ml_health_raw - r.target_health) < 15 for r in good.collect())
    hole = df.withColumn("x1", F.when((F.col("belt_id") == "a") & (F.col("mi") == 7), None).otherwise(F.col("x1")))
    got = {(r.belt_id, r.prediction_status) for r in MS.score_table(hole, models, ml_only=True).collect()}
    assert got == {("a", "fallback_feature_prep_failed"), ("b", "ok_ml_only")}
    assert {r.prediction_status for r in MS.score_table(df.drop("x2"), models).collect()} == {"fallback_feature_prep_failed"}
    assert {r.prediction_status for r in MS.score_table(df, None).collect()} == {"safe_mode_calendar"}
    assert {r.prediction_status for r in MS.score_table(df, None, ml_only=True).collect()} == {"ml_only_model_unavailable"}
    assert TR.load_models(str(tmp_path / "none")) is None


def test_tables_by_day(spark, tmp_path):
    from wearcast.sources.sinks import cached_by_day, read_by_day, write_report

    df = spark.range(4000).select(F.lit("7").alias("belt_id"), F.col("id").alias("mi"), F.col("id").cast("double").alias("v"))
    path = str(tmp_path / "t")
    built = []
    for _ in range(2):
        out = cached_by_day(spark, path, lambda: built.append(1) or df)
        assert sorted(map(tuple, out.select("belt_id", "mi", "v").collect())) == sorted(map(tuple, df.collect()))
    assert len(built) == 1
    last = read_by_day(spark, path, last_days=1)
    assert last.agg(F.min("mi")).first()[0] == 2880
    assert "PartitionFilters: [isnotnull(day" in last._jdf.queryExecution().toString()
    write_report(df.limit(3), str(tmp_path / "r"), "mi")
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 3


@pytest.mark.parametrize("fan", [2, 1024])
def test_scans_over_three_levels(spark, fan):
    from wearcast.operators.scan import carry_prev_next, sequence_index

    n = 60
    df = spark.range(n).select(F.lit("b").alias("k"), F.col("id").alias("o"), F.floor(F.col("id") / 3).alias("chunk"),
                               F.when(F.col("id").isin(1, 2, 17, 18, 50), F.col("id").cast("double")).alias("v")).repartition(7)
    known = [1, 2, 17, 18, 50]
    for r in carry_prev_next(df, ["k"], "o", ["v"], "chunk", fan=fan).collect():
        assert (r._p_v and r._p_v.o) == max((x for x in known if x <= r.o), default=None)
        assert (r._n_v and r._n_v.o) == min((x for x in known if x > r.o), default=None)
    assert all(r.seq == r.o for r in sequence_index(df, ["k"], ["o"], "chunk", fan=fan).collect())


def test_dedup_is_a_hash_aggregate(spark):
    df = spark.range(5).select(F.lit("b").alias("belt_id"), F.lit("s").alias("sensorid"), F.to_timestamp(F.lit("2024-01-01")).alias("ts"),
                               F.col("id").cast("double").alias("avg_value"), F.lit(None).cast("double").alias("min_value"), F.col("id").alias("ingest_seq"))
    plan = dedup_keep_last(df)._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert [r.avg_value for r in dedup_keep_last(df).collect()] == [4.0]
