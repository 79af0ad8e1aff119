"""Hand-computed fixtures (FIXTURES.md section 3) run through the Spark operators."""

import math

import pytest
from pyspark.sql import functions as F

from wearcast.config import CURRENT_SENSOR, ELONG_SENSOR, TEMP_SENSOR, Thresholds
from wearcast.functions import formulas as fx
from wearcast.operators import clean as C
from wearcast.operators import grid as G
from wearcast.operators.rolling import Spec, rolling_block, std_from
from wearcast.operators.scan import forward_back_fill, lag_columns, sequence_index
from wearcast.plans import score as S
from wearcast.sources.readings import read_sensor_csv


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(*cols[:1]).collect()]


def test_csv_reader_and_cleaning(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_text(
        "sensorid,@timestamp,avg_value\n"
        f"{TEMP_SENSOR},2026-01-01T00:00:00Z,1,extra\n"            # too many fields -> dropped
        f" {ELONG_SENSOR} ,2026-01-01T00:00:00+05:30, 5 \n"         # trimmed, offset, blanks
        f"{CURRENT_SENSOR},2026-01-01T00:01:00Z\n"                  # short line -> avg null -> dropped
        "unknown/sensor,2026-01-01T00:00:00Z,3\n"                    # unknown sensor
        f"{TEMP_SENSOR},bad,3\n"
        f"{TEMP_SENSOR},2026-01-01T00:02:00Z,abc\n"
        f"{TEMP_SENSOR},2026-01-01T00:03:00Z,NaN\n"
        f"{TEMP_SENSOR},2026-01-01T00:04:00Z,1e3\n"
        f"{TEMP_SENSOR},2026-01-01T00:05:00Z,inf\n"
    )
    df = C.core_sensor_filter(read_sensor_csv(spark, str(p)))
    got = sorted((r.sensorid, r.ts.isoformat(), r.avg_value) for r in df.collect())
    assert got == sorted([
        (ELONG_SENSOR, "2025-12-31T18:30:00", 5.0),
        (TEMP_SENSOR, "2026-01-01T00:04:00", 1000.0),
        (TEMP_SENSOR, "2026-01-01T00:05:00", math.inf),
    ])


def test_missing_required_column(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text("sensorid,avg_value\nx,1\n")
    with pytest.raises(ValueError):
        read_sensor_csv(spark, str(p))


def _readings(spark, data):
    return spark.createDataFrame(
        [("b", s, ts, v, None, None, None, seq) for s, ts, v, seq in data],
        "belt_id string, sensorid string, ts string, avg_value double, min_value double, "
        "max_value double, std_deviation double, ingest_seq long").withColumn("ts", F.to_timestamp("ts"))


def test_dedup_keeps_last_and_range_filter(spark):
    df = _readings(spark, [(TEMP_SENSOR, "2026-01-01 00:00:00", 1.0, 1), (TEMP_SENSOR, "2026-01-01 00:00:00", 3.0, 2),
                           (ELONG_SENSOR, "2026-01-01 00:00:00", 0.0, 3), (ELONG_SENSOR, "2026-01-01 00:01:00", 100.0, 4),
                           (ELONG_SENSOR, "2026-01-01 00:02:00", 100.1, 5)])
    d = C.dedup_keep_last(df)
    assert [r.avg_value for r in d.where(F.col("sensorid") == TEMP_SENSOR).collect()] == [3.0]
    th = Thresholds(ranges={ELONG_SENSOR: (0.0, 100.0)})
    kept = sorted(r.avg_value for r in C.range_filter(d, th).where(F.col("sensorid") == ELONG_SENSOR).collect())
    assert kept == [0.0, 100.0]


def test_grid_interpolation_and_means(spark):
    df = _readings(spark, [(TEMP_SENSOR, "2026-01-01 00:00:30", 10.0, 1), (TEMP_SENSOR, "2026-01-01 00:03:10", 40.0, 2),
                           (ELONG_SENSOR, "2026-01-01 00:00:10", 10.0, 3), (ELONG_SENSOR, "2026-01-01 00:00:50", 20.0, 4)])
    g = G.minute_grid(G.minute_means(df), columns=("avg_value",))
    t = [r.avg_value for r in g.where(F.col("sensorid") == TEMP_SENSOR).orderBy("mi").collect()]
    assert t == [10.0, 20.0, 30.0, 40.0]
    e = [r.avg_value for r in g.where(F.col("sensorid") == ELONG_SENSOR).collect()]
    assert e == [15.0]


def test_interpolation_skips_nulls_per_column(spark):
    vals = [None, None, 1.0, None, 4.0, None]
    means = spark.createDataFrame([("b", "s", i, 0.0, v, 2.0 if i == 0 else None) for i, v in enumerate(vals)],
                                  "belt_id string, sensorid string, mi long, avg_value double, min_value double, "
                                  "std_deviation double")
    g = G.minute_grid(means, columns=("avg_value", "min_value"))
    out = [(r.min_value, r.std_deviation) for r in g.orderBy("mi").collect()]
    assert [o[0] for o in out] == [1.0, 1.0, 1.0, 2.5, 4.0, 4.0]
    assert [o[1] for o in out][:2] == [2.0, 0.0]


def _series(spark, values, start=0):
    return spark.createDataFrame([("b", start + i, float(v)) for i, v in enumerate(values)],
                                 "belt_id string, mi long, x double")


def test_block_windows_match_fixtures(spark):
    df = rolling_block(_series(spark, range(1, 12)), ["belt_id"], "mi", 60, [Spec("w", "x", ("n", "mean", "m2", "slope"))])
    r = df.orderBy("mi").collect()
    # slope with min_periods 10 (batch) -> 0 for rows 1..9, then 1
    assert [1.0 if (x.w_n >= 10 and abs(x.w_slope - 1) < 1e-12) else 0.0 for x in r] == [0.0] * 9 + [1.0, 1.0]
    four = rolling_block(_series(spark, [1, 2, 3, 4]), ["belt_id"], "mi", 60, [Spec("w", "x", ("n", "mean", "m2"))])
    last = four.orderBy(F.desc("mi")).first()
    assert abs(last.w_mean - 2.5) < 1e-12
    samp = spark.range(1).select(std_from(F.lit(last.w_n), F.lit(last.w_m2), 1)).first()[0]
    pop = spark.range(1).select(std_from(F.lit(last.w_n), F.lit(last.w_m2), 0)).first()[0]
    assert abs(samp - 1.290994) < 1e-6 and abs(pop - 1.118034) < 1e-6


@pytest.mark.parametrize("w", [3, 5, 7])
def test_block_method_equals_sliding_frame(spark, w):
    import random
    random.seed(w)
    vals = [random.uniform(0, 100) for _ in range(53)]
    df = _series(spark, vals, start=17)
    got = rolling_block(df, ["belt_id"], "mi", w, [Spec("w", "x", ("n", "mean", "m2", "min", "max", "slope", "sum"))])
    from pyspark.sql import Window
    win = Window.partitionBy("belt_id").orderBy("mi").rowsBetween(-(w - 1), 0)
    ref = df.select("mi", F.count("x").over(win).alias("n"), F.avg("x").over(win).alias("mean"),
                    F.var_pop("x").over(win).alias("vp"), F.min("x").over(win).alias("mn"),
                    F.max("x").over(win).alias("mx"), F.regr_slope("x", "mi").over(win).alias("sl"),
                    F.sum("x").over(win).alias("s"))
    j = {r.mi: r for r in ref.collect()}
    for r in got.collect():
        e = j[r.mi]
        assert r.w_n == e.n and abs(r.w_mean - e.mean) < 1e-9 and abs(r.w_m2 - e.vp * e.n) < 1e-7
        assert r.w_min == e.mn and r.w_max == e.mx and abs(r.w_sum - e.s) < 1e-9
        if e.n >= 2:
            assert abs(r.w_slope - e.sl) < 1e-9


def test_lags_and_fill_and_sequence(spark):
    df = _series(spark, [1, 2, 3, 4, 5, 6])
    l5 = lag_columns(df, ["belt_id"], "mi", {"l": ("x", 5)}, chunk_size=2 * 5)
    micro = [0.0 if r.l is None else r.x - r.l for r in l5.orderBy("mi").collect()]
    assert micro == [0, 0, 0, 0, 0, 5]
    s = spark.createDataFrame([("b", i, v) for i, v in enumerate([None, None, 1.0, None, 4.0, None])],
                              "belt_id string, mi long, x double").withColumn("c", F.floor(F.col("mi") / 2))
    filled = [r.x for r in forward_back_fill(s, ["belt_id"], "mi", ["x"], "c").orderBy("mi").collect()]
    assert filled == [1.0, 1.0, 1.0, 1.0, 4.0, 4.0]
    q = sequence_index(s, ["belt_id"], ["mi"], "c", "seq")
    assert [r.seq for r in q.orderBy("mi").collect()] == list(range(6))


SCALARS = [  # temp, elong, curr, trend_1h, trend_6h, vol_6h, var_12h -> expected
    ((55, 280, 40, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)),
    ((95, 305, 50, 0.02, 0.012, 3, 4), (0.6533, 1, 2.25, 0.56, 875, 2, 0, 0.8287, 1, 1.0533, 0)),
    ((102, 312, 85, 0.05, 0.03, 6, 8), (1.0367, 1, 3, 1.68, 1344, 3, 3, 2.8128, 2, 3.1367, 1)),
    ((60, 270, 62, 0, 0.006, 0, 0), (0.06, 0, 0, 0, 0, 1, 0, 0.221, 1, 0.26, 0)),
]


@pytest.mark.parametrize("inp,exp", SCALARS)
def test_scalar_formulas(spark, inp, exp):
    from wearcast.plans.features import condition_features, scalar_features

    th = Thresholds()
    df = spark.createDataFrame([tuple(float(x) for x in inp)],
                               "temp_avg double, elong_avg double, curr_avg double, elong_trend_1h double, "
                               "elong_trend_6h double, elong_volatility_6h double, temp_variability_12h double")
    df = df.withColumn("elong_delta", fx.elong_delta(F.col("elong_avg"), th))
    df = df.withColumns(fx.threshold_flags(F.col("temp_avg"), F.col("elong_avg"), F.col("curr_avg"), th))
    df = df.withColumns({"warning_count": fx.warning_count(), "critical_count": fx.critical_count()})
    r = condition_features(scalar_features(df, th)).first()
    got = (r.degradation_index, r.degradation_rising_flag, r.temp_spike_index, r.temp_elong_coupling,
           r.temp_elong_interaction, r.warning_count, r.critical_count, r.condition_risk_score,
           r.condition_state_code, r.failure_proximity, r.failure_trigger)
    for g, e in zip(got, exp):
        assert abs(g - e) < 1e-4, (got, exp)


def test_targets_safe_mode_fusion_and_bands(spark):
    th = Thresholds()
    t = spark.createDataFrame([(2000.0, 0.0, 0.0, 0.0), (2000.0, 0.5, 3.0, 0.0), (2000.0, 0.7, 10.0, 2.0),
                               (2000.0, 1.2, 24.0, 5.0)], "cal double, deg double, w24 double, c24 double")
    r = t.select(fx.target_health(F.col("deg"), F.col("w24"), F.col("c24")).alias("h"),
                 fx.target_rul_days(F.col("cal"), F.col("deg"), F.col("c24"), th).alias("r")).collect()
    assert [(round(x.h, 6), round(x.r, 6)) for x in r] == [(100, 2000), (54, 1000), (14, 500), (0, 0)]

    sm = spark.createDataFrame([(2091.0, 0.0, 0), (2000.0, 0.8, 2), (2000.0, 2.0, 3), (2500.0, 0.0, 0)],
                               "calendar_rul_days double, degradation_index double, warning_count int")
    assert [round(x.final_rul_days, 6) for x in S.safe_mode(sm, th).collect()] == [2091, 1560, 1100, 2190]

    fu = spark.createDataFrame([(90.0, 2000.0, 0.2, 0, 0), (60.0, 1000.0, 0.8, 2, 1), (45.0, 100.0, 1.5, 3, 3)],
                               "ml_health double, ml_rul_days double, degradation_index double, "
                               "warning_count int, critical_count int")
    out = S.fuse(fu, th).collect()
    assert [round(x.final_rul_days, 4) for x in out] == [1968, 796, 65]
    assert [round(x.final_health, 4) for x in out] == [89.9589, 52.9041, 32.3904]

    bands = spark.createDataFrame([(95.0, 2000.0), (85.0, 1080.0), (75.0, 181.0), (65.0, 500.0), (64.99, 2000.0),
                                   (50.0, 2000.0), (95.0, 90.0)], "ml_health double, ml_rul_days double")
    b = [(x.risk, x.health_band, x.rul_band) for x in S.alert_bands(bands, th).collect()]
    assert b == [("NORMAL", "EXCELLENT", "NORMAL"), ("NORMAL", "GOOD", "MAINTENANCE_DUE"),
                 ("NORMAL", "MAINTENANCE_DUE", "MAINTENANCE_DUE"), ("WARNING", "WARNING", "MAINTENANCE_DUE"),
                 ("WARNING", "CRITICAL", "NORMAL"), ("CRITICAL", "CRITICAL", "NORMAL"),
                 ("CRITICAL", "EXCELLENT", "CRITICAL")]


def test_operational_risk(spark):
    base = {"critical_count": 0, "warning_count": 0, "condition_state_code": 0, "degradation_index": 0.0,
            "degradation_rising_flag": 0, "elong_trend_6h": 0.0, "final_health": 100.0, "final_rul_days": 2000.0,
            "quality_ok": True, "confidence_level": "HIGH"}
    cases = [({"quality_ok": False, "critical_count": 3}, "LOW_CONFIDENCE"),
             ({"critical_count": 2, "degradation_index": 0.8}, "CRITICAL"),
             ({"critical_count": 1, "warning_count": 1}, "WARNING"),
             ({"final_rul_days": 90.0, "degradation_index": 0.8}, "CRITICAL"),
             ({"final_rul_days": 90.0}, "WARNING"), ({}, "NORMAL")]
    data = [{**base, **c} for c, _ in cases]
    schema = ("critical_count int, warning_count int, condition_state_code int, degradation_index double, "
              "degradation_rising_flag int, elong_trend_6h double, final_health double, final_rul_days double, "
              "quality_ok boolean, confidence_level string")
    df = spark.createDataFrame([tuple(d[k.split()[0]] for k in schema.split(", ")) for d in data], schema)
    got = [r.risk_level for r in S.operational_risk(df).collect()]
    assert got == [e for _, e in cases]


def test_event_normaliser(spark):
    from wearcast.streaming.normalize import lenient_value, normalize

    payloads = ['{"sensorid":"s","avg_value":"3.5"}', '{"sensorid":"s"}', '{"sensorid":"s","avg_value":null}',
                '{"sensorid":"s","avg_value":"x"}', '{"sensorid":"s","avg_value":10,"std_deviation":2}',
                '{"belt_id":"  ","sensorid":"s","avg_value":1}', '[1]', '{bad']
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "seq long, value string")
    fixed = F.to_timestamp(F.lit("2026-01-01 00:00:00"))
    out = {r.seq: r for r in normalize(df, fallback_ts=fixed).collect()}
    assert sorted(out) == [0, 1, 4, 5]
    assert (out[0].belt_id, out[0].avg_value, out[0].min_value, out[0].max_value) == ("belt-1", 3.5, 3.5, 3.5)
    assert out[1].avg_value == 0.0
    assert (out[4].min_value, out[4].max_value, out[4].variance, out[4].median) == (8.0, 12.0, 4.0, 10.0)
    assert out[5].belt_id == "belt-1"
    lv = {r.seq: r.avg_value for r in lenient_value(df).collect()}
    assert lv == {0: 3.5, 1: 0.0, 2: 0.0, 3: 0.0, 4: 10.0, 5: 1.0}


def test_split_folds_upsample_counts(spark):
    from wearcast.plans import training as TR

    df = spark.range(180001).select(F.lit("b").alias("belt_id"), F.col("id").alias("mi"))
    s = TR.chrono_split_summary(df, 0.2).first()
    assert (s.n_train, s.n_test) == (144000, 36001)
    ten = spark.range(10).select(F.lit("b").alias("belt_id"), F.col("id").alias("mi"))
    folds = [(r.fold, r.n_fold_train, r.val_start_mi, r.val_end_mi) for r in TR.cv_fold_summary(ten, 3).orderBy("fold").collect()]
    assert folds == [(1, 4, 4, 6), (2, 6, 6, 8), (3, 8, 8, 10)]
    tr = spark.range(144000).select(F.lit("b").alias("belt_id"), F.col("id").alias("mi"),
                                    (F.col("id") < 8790).cast("int").alias("is_critical_label"))
    p = TR.upsample_plan(tr).first()
    assert (p.n_critical_upsampled, p.n_train_balanced) == (67605, 202815)
    up = TR.upsample(tr.withColumn("weight", F.lit(1.0)))
    assert up.count() == 202815 and up.where("is_critical_label = 1").count() == 67605
