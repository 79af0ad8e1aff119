"""Registered queries: one callable per inventory item (or tight group),
each `(spark, sf_dir) -> DataFrame` over the driver's whole tables.

Outputs that come out of floating-point windows are summarised per
(belt, day) with `q4(x) = round(x * 1e4) / 1e4`, which both engines
compute identically for identical inputs (plain `round(x, 4)` differs
between engines on decimal ties).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CORE_SENSORS, FIXTURE_BELTS, Thresholds
from ..functions.formulas import QK
from ..operators import clean as C
from ..operators import grid as G
from ..session import checkpoint_dir, materialize
from ..sources.readings import events_path, read_events_as_readings, with_replayed_duplicates
from ..sources.sinks import read_by_day, write_by_day
from . import features as FE
from . import score as S
from . import training as TR

_MEMO: dict = {}


def q4(c: Column) -> Column:
    return F.round(c * F.lit(QK)) / F.lit(QK)


def rounded(df: DataFrame, exact: tuple[str, ...]) -> DataFrame:
    """Floats of a report on the grid of `q4`, for comparison between engines only."""
    return df.select(*[F.col(c) if c in exact else q4(F.col(c)).alias(c) for c in df.columns])


def day_of(mi: Column) -> Column:
    return F.date_format(F.date_from_unix_date(F.floor(mi / 1440).cast("int")), "yyyy-MM-dd")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return read_events_as_readings(spark, sf)


def _memo(spark: SparkSession, sf: str, name: str, build, save: bool = True):
    """Tables shared by several queries are built once per application and
    kept as materialised Parquet in the checkpoint folder, for as long as the
    events they come from are the same files."""
    key = (spark.sparkContext.applicationId, name, _state(spark, events_path(sf)))
    if key not in _MEMO:
        _MEMO[key] = materialize(build()) if save else build()
    return _MEMO[key]


def _state(spark: SparkSession, path: str) -> tuple:
    """Path, size and time of the files of a table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p))


def means(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned readings binned to minutes (AGG-1, PRJ-*, AGG-2)."""
    return _memo(spark, sf, "means", lambda: G.minute_means(C.clean_readings(readings(spark, sf))))


def features(spark: SparkSession, sf: str) -> DataFrame:
    """The batch feature table for one scale factor."""
    return _memo(spark, sf, "features",
                 lambda: FE.build_features(readings(spark, sf), spark, belts=FIXTURE_BELTS, means=means(spark, sf)),
                 save=False)  # built from a stored table already


def daily(df: DataFrame, cols: list[str], extra: list[Column] | None = None) -> DataFrame:
    return (df.groupBy("belt_id", day_of(F.col("mi")).alias("day"))
              .agg(F.count(F.lit(1)).alias("n"), *[q4(F.avg(c)).alias(c) for c in cols], *(extra or [])))


# ----------------------------------------------------------- cleaning -----
def clean_coerce(spark, sf):
    r = C.core_sensor_filter(readings(spark, sf))
    return r.select("belt_id", "sensorid", F.unix_micros("ts").alias("ts_us"), "avg_value",
                    "min_value", "max_value", "std_deviation")


def dedup_last(spark, sf):
    r = C.dedup_keep_last(C.core_sensor_filter(with_replayed_duplicates(readings(spark, sf))))
    return r.select("belt_id", "sensorid", F.unix_micros("ts").alias("ts_us"), "avg_value")


RANGE_TEST = Thresholds(ranges={CORE_SENSORS[0]: (0.0, 100.0), CORE_SENSORS[1]: (260.0, None),
                                CORE_SENSORS[2]: (None, 150.0)})


def range_filter(spark, sf):
    r = C.range_filter(C.core_sensor_filter(readings(spark, sf)), RANGE_TEST)
    return r.groupBy("belt_id", "sensorid").agg(
        F.count(F.lit(1)).alias("n_kept"), q4(F.sum("avg_value")).alias("sum_avg"),
        F.min("avg_value").alias("min_avg"), F.max("avg_value").alias("max_avg"))


def minute_resample(spark, sf):
    m = means(spark, sf)
    return m.select("belt_id", "sensorid", "mi", "avg_value", "min_value", "max_value", "std_deviation")


def minute_grid_interpolated(spark, sf):
    g = G.minute_grid(means(spark, sf))
    return (g.groupBy("belt_id", "sensorid", day_of(F.col("mi")).alias("day"))
             .agg(F.count(F.lit(1)).alias("n"), F.min("mi").alias("first_mi"), F.max("mi").alias("last_mi"),
                  *[q4(F.avg(c)).alias(c) for c in ("avg_value", "min_value", "max_value", "std_deviation")],
                  F.sum(F.col("min_value").isNull().cast("int")).alias("n_null_min")))


def sensor_coverage(spark, sf):
    cov = C.sensor_coverage(C.clean_readings(readings(spark, sf)))
    return cov.select("belt_id", "n_sensors_present",
                      F.array_join("missing_sensors", ",").alias("missing_sensors"), "coverage_ok")


# ------------------------------------------------------------ features -----
GROUPS = {
    "wide_pivot": ["temp_avg", "elong_avg", "curr_avg"],
    **{f"rolling_stats_{lbl}": [f"{s}_{lbl}_{st}" for s in ("temp", "elong", "curr")
                                for st in ("mean", "std", "min", "max")] for lbl in ("1h", "6h", "12h", "24h")},
    "utilization": ["is_idle", "high_load", "utilization_1h", "utilization_6h", "high_load_share_6h"],
    "current_percentile": ["current_percentile"],
    "volatility": ["current_volatility_6h", "elong_volatility_6h", "temp_variability_12h"],
    "lag_diffs": ["elong_delta", "elong_rate_12h", "elong_delta_rate", "elong_micro_trend"],
    "rolling_slopes": ["elong_trend_1h", "elong_trend_6h", "elong_trend_24h", "temp_trend_1h",
                       "temp_trend_6h", "temp_trend_24h", "elong_accel_6h"],
    "event_intensity_24h": ["warning_event_count_24h", "critical_event_count_24h"],
    "degradation": ["degradation_index", "degradation_rising_flag"],
    "thermal_features": ["temp_above_baseline", "temp_spike_index"],
    "interactions": ["temp_elong_coupling", "temp_elong_interaction", "temp_elong_risk_flag"],
    "threshold_flags": ["temp_warning", "temp_critical", "elong_warning", "elong_critical",
                        "current_warning", "current_critical", "warning_count", "critical_count"],
    "condition_state": ["condition_risk_score", "condition_state_code", "is_failure",
                        "failure_proximity", "failure_trigger"],
    "targets": ["calendar_rul_days", "target_health", "target_rul_days", "is_critical", "runtime_age_hours"],
}


def _group_query(name):
    cols = GROUPS[name]

    def q(spark, sf):
        extra = []
        if name == "condition_state":
            extra = [F.sum((F.col("condition_state") == s).cast("int")).alias(f"n_{s.lower()}")
                     for s in ("CRITICAL", "WARNING", "NORMAL")]
        return daily(features(spark, sf), cols, extra)
    q.__name__ = name
    return q


# ------------------------------------------------------------- scoring -----
TH = Thresholds()


def safe_mode_score(spark, sf):
    s = S.safe_mode(features(spark, sf), TH)
    return daily(s, ["ml_rul_days", "ml_health", "final_rul_days", "final_health"])


def _pseudo_scored(spark, sf, n=100, ml_only=False):
    """Model-shaped inputs from the data itself: the targets stand in for the
    regressor outputs so fusion/smoothing/confidence/risk are checkable."""
    sl = S.latest_n(features(spark, sf), n)
    sl = sl.withColumns({"ml_health_pred": F.col("target_health"), "ml_rul_pred": F.col("target_rul_days")})
    return S.score_with_predictions(sl, TH, ml_only=ml_only, log_target=False)


def prediction_smoothing(spark, sf):
    s = _pseudo_scored(spark, sf)
    return s.groupBy("belt_id").agg(
        F.count(F.lit(1)).alias("n"), q4(F.avg("ml_health")).alias("ml_health"),
        q4(F.avg("ml_rul_days")).alias("ml_rul_days"), q4(F.min("ml_health")).alias("min_ml_health"),
        q4(F.min("ml_rul_days")).alias("min_ml_rul_days"))


def hybrid_fusion(spark, sf):
    s = _pseudo_scored(spark, sf)
    return s.groupBy("belt_id").agg(
        q4(F.avg("final_health")).alias("final_health"), q4(F.avg("final_rul_days")).alias("final_rul_days"),
        q4(F.avg("failure_risk_score")).alias("failure_risk_score"),
        q4(F.avg("anomaly_score")).alias("anomaly_score"), q4(F.max("anomaly_score")).alias("max_anomaly"),
        F.sum("early_failure_flag").alias("early_flags"),
        F.sum((F.col("confidence_level") == "LOW").cast("int")).alias("n_low"),
        F.sum((F.col("confidence_level") == "HIGH").cast("int")).alias("n_high"))


def _report(spark, sf, scorer):
    return S.report(features(spark, sf), TH, scorer)


def quality_gate(spark, sf):
    g = S.quality_gate(S.latest_n(features(spark, sf), 100), th=TH)
    return g.select("belt_id", "row_count", "required_feature_count", q4(F.col("missing_ratio")).alias("missing_ratio"),
                    "quality_ok")


def operational_risk(spark, sf):
    r = _report(spark, sf, lambda d: S.safe_mode(d, TH))
    return r.select("belt_id", "mi", "risk_level", "quality_ok", "confidence_level", "prediction_status",
                    F.array_join("risk_reasons", ";").alias("risk_reasons"))


def risk_reasons(spark, sf):
    r = _report(spark, sf, lambda d: S.score_with_predictions(
        d.withColumns({"ml_health_pred": F.col("target_health"), "ml_rul_pred": F.col("target_rul_days")}),
        TH, log_target=False))
    return r.select("belt_id", "mi", "risk_level", "confidence_level", q4(F.col("final_health")).alias("final_health"),
                    q4(F.col("final_rul_days")).alias("final_rul_days"),
                    F.array_join("risk_reasons", ";").alias("risk_reasons"))


def alert_bands(spark, sf):
    s = S.safe_mode(features(spark, sf), TH).withColumns(
        {"_h": F.col("final_health"), "_r": F.col("final_rul_days")})
    s = S.alert_bands(s, TH, "final_health", "final_rul_days")
    # averages of the unrounded values (2-place rounding ties differ by engine)
    return s.groupBy("belt_id", "risk", "health_band", "rul_band").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_alert").cast("int")).alias("n_alert"),
        q4(F.avg("_h")).alias("final_health"), q4(F.avg("_r")).alias("final_rul_days"))


def latest_per_belt(spark, sf):
    last = S.latest_row(features(spark, sf))
    return last.select("belt_id", "mi", *[q4(F.col(c)).alias(c) for c in
                                          ("temp_avg", "elong_avg", "curr_avg", "degradation_index",
                                           "calendar_rul_days", "target_health")], "condition_state")


def summary(spark, sf):
    r = _report(spark, sf, lambda d: S.safe_mode(d, TH))
    s = S.summary(r)
    return s.select("belt_id", "timestamp_utc", q4(F.col("health_score")).alias("health_score"),
                    q4(F.col("rul_days")).alias("rul_days"), "status", "confidence", "prediction_mode")


# ------------------------------------------------------ reports / train ----
def quality_report(spark, sf):
    clean = G.minute_grid(means(spark, sf))
    exact = ("belt_id", "rows_after_preprocessing", "warning_events", "critical_events")
    return rounded(S.quality_report(clean, features(spark, sf)), exact)


def regression_metrics(spark, sf):
    s = S.safe_mode(features(spark, sf), TH)
    m = TR.regression_metrics(s, [("health", "target_health", "final_health"),
                                  ("rul", "target_rul_days", "final_rul_days")], n_features=1, by=["belt_id"])
    return rounded(m, ("belt_id", "n"))


def segment_metrics(spark, sf):
    s = S.safe_mode(features(spark, sf), TH)
    m = TR.segment_metrics(s, "target_health", "final_health", "target_rul_days", "final_rul_days")
    return rounded(m, ("belt_id", "condition_state_code", "n"))


def chrono_split(spark, sf):
    return TR.chrono_split_summary(features(spark, sf), TR.DEFAULT_TEST_SIZE)


def cv_folds(spark, sf):
    tr = TR.chrono_split(features(spark, sf), TR.DEFAULT_TEST_SIZE)[0]
    return TR.cv_fold_summary(tr, k=3)


def cv_fold_rows(spark, sf):
    """Rows and minute sums of the fold frames, over a set in which the minutes
    of critical rows repeat as they do after upsampling."""
    tr = TR.chrono_split(TR.with_critical_label(features(spark, sf)), TR.DEFAULT_TEST_SIZE)[0]
    return TR.cv_fold_rows(tr.unionByName(tr.where("is_critical_label = 1")), k=3)


def features_roundtrip(spark, sf):
    """Features written by belt and day and read again (SNK-1, SNK-7, TOP-1)."""
    path = f"{checkpoint_dir(spark)}/features-by-day/{uuid.uuid4().hex}"
    write_by_day(features(spark, sf), path)
    return daily(read_by_day(spark, path), GROUPS["degradation"])


def sample_weights(spark, sf):
    w = TR.with_weights(TR.with_critical_label(features(spark, sf)))
    return daily(w, ["is_critical_label", "weight"])


def upsample_counts(spark, sf):
    tr = TR.chrono_split(TR.with_critical_label(features(spark, sf)), TR.DEFAULT_TEST_SIZE)[0]
    return TR.upsample_plan(tr)


# --------------------------------------------------------------- stream ----
def stream_feats(spark, sf):
    from ..streaming import batch_form as B
    return _memo(spark, sf, "stream_features", lambda: B.stream_features(spark, sf))


def stream_alert_rows(spark, sf):
    from ..streaming import batch_form as B
    return _memo(spark, sf, "stream_alerts", lambda: B.stream_alerts_from(stream_feats(spark, sf), TH))

def normalize_events(spark, sf):
    from ..streaming import normalize as N
    ev = N.events_as_json(spark, sf)
    out = N.normalize(ev)
    return out.select("belt_id", "sensorid", F.unix_micros("ts").alias("ts_us"), "avg_value", "min_value",
                      "max_value", "std_deviation", "variance", "median")


def stream_features_batch_form(spark, sf):
    f = stream_feats(spark, sf)
    cols = ["temp_avg", "elong_avg", "curr_avg", "temp_1h_std", "elong_24h_mean", "curr_12h_max",
            "utilization_1h", "current_percentile", "elong_rate_12h", "elong_delta_rate", "elong_micro_trend",
            "elong_trend_6h", "temp_trend_24h", "elong_volatility_6h", "degradation_index", "failure_proximity",
            "warning_count", "critical_count"]
    return (f.groupBy("belt_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
             .agg(F.count(F.lit(1)).alias("n"), *[q4(F.avg(c)).alias(c) for c in cols]))


def stream_alerts(spark, sf):
    a = stream_alert_rows(spark, sf)
    return a.groupBy("belt_id", "risk", "health_band", "rul_band").agg(
        F.count(F.lit(1)).alias("n"), q4(F.avg("ml_health")).alias("ml_health"),
        q4(F.avg("ml_rul_days")).alias("ml_rul_days"), q4(F.avg("failure_risk_score")).alias("failure_risk_score"))


def topic_routing(spark, sf):
    from ..streaming import batch_form as B
    return B.topic_routing_counts(spark, sf, stream_alert_rows(spark, sf))


def replay_rows(spark, sf):
    from ..sources import stream as SS
    rep = SS.replay_events(C.core_sensor_filter(readings(spark, sf)))
    return SS.parse_replayed(rep).select("sensorid", F.unix_micros("ts").alias("ts_us"), "avg_value")


def train_score(spark, sf):
    return TR.train_and_score(features(spark, sf), spark)


def streaming_run(spark, sf):
    from ..streaming import query as Q
    return Q.run_stream_over_events(spark, sf)


def streaming_alert_counts(spark, sf):
    """What the stateful stream emitted, per belt and alert class."""
    a = streaming_run(spark, sf)
    return a.groupBy("belt_id", "risk", "health_band", "rul_band").agg(
        F.count(F.lit(1)).alias("n"), q4(F.min("degradation_index")).alias("min_degradation"),
        q4(F.max("degradation_index")).alias("max_degradation"), q4(F.avg("failure_risk_score")).alias("failure_risk_score"), q4(F.avg("degradation_index")).alias("degradation_index"))


def _stream_job(spark, payloads, store=None, max_offsets=None, event_time=None):
    """The whole streaming job over payloads(key, seq, value): topic folder in, tables out."""
    from ..sources.stream import RAW_TOPIC
    from ..sources.topics import append_topic, read_topics
    from ..streaming import job as J
    from ..streaming.query import TRIGGER
    base = f"{checkpoint_dir(spark)}/stream-job/{uuid.uuid4().hex}"
    append_topic(payloads, f"{base}/topics", RAW_TOPIC)
    events = read_topics(spark, f"{base}/topics", [RAW_TOPIC], f"{base}/progress", max_offsets or TRIGGER)
    q = J.start(events, J.Routes(f"{base}/out", TH, store), f"{base}/checkpoint", event_time)
    q.processAllAvailable()
    q.stop()
    return f"{base}/out"


def stream_routed(spark, sf):
    """Rows of the job's raw, prediction and bad-record tables, per belt."""
    from ..streaming import job as J
    from ..streaming import normalize as N
    payloads = N.flagged(N.events_as_json(spark, sf), keep_value=True).select(F.col("belt_id").alias("key"), F.col("ingest_seq").alias("seq"), "value")
    out = _stream_job(spark, payloads)
    tables = [J.read_routed(spark, out, name).select(F.lit(name).alias("sink"), belt.alias("belt_id"))
              for name, belt in ((J.RAW, F.coalesce("belt_id", F.lit(""))), (J.PREDICTIONS, F.col("belt_id")), (J.BAD, F.lit("")))]
    rows = tables[0].unionByName(tables[1]).unionByName(tables[2])
    return rows.groupBy("sink", "belt_id").agg(F.count(F.lit(1)).alias("n"))


# a pair of formulas in the place of forests, so that SQL can say what the stream must emit
FORMULA = {"health": "100 - 45 * degradation_index", "rul": "2000 - 330 * failure_proximity", "features": ["degradation_index", "failure_proximity"]}


def formula_store(spark, path, lenient=True):
    """A model store that holds the pair of FORMULA; `lenient` adds a feature that no table has."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer

    from . import model_store
    pair = [PipelineModel([SQLTransformer(statement=f"SELECT *, {FORMULA[k]}{' + no_such_feature' * lenient} AS prediction FROM __THIS__")]) for k in ("health", "rul")]
    model_store.save(*pair, path, FORMULA["features"] + ["no_such_feature"] * lenient, {}, target_transform="none")
    return path


def batch_model_scores(spark, sf):
    """ML-11, ML-21: the whole feature table scored with a saved pair, per belt and day."""
    from . import jobs
    store = formula_store(spark, f"{checkpoint_dir(spark)}/models/{uuid.uuid4().hex}", lenient=False)
    s = jobs.scored(features(spark, sf), store, TH)
    return s.groupBy("belt_id", day_of(F.col("mi")).alias("day"), "prediction_status").agg(
        F.count(F.lit(1)).alias("n"), q4(F.avg("final_health")).alias("final_health"), q4(F.avg("final_rul_days")).alias("final_rul_days"),
        q4(F.min("final_health")).alias("min_health"), q4(F.max("final_rul_days")).alias("max_rul"), q4(F.max("anomaly_score")).alias("max_anomaly"),
        F.sum((F.col("confidence_level") == "LOW").cast("int")).alias("n_low"), F.sum("early_failure_flag").alias("n_early"))


def stream_model_alerts(spark, sf):
    """What the job emits with a saved model, per belt and alert class."""
    from ..sources.stream import replay_events
    from ..streaming import job as J
    r = readings(spark, sf)
    payloads = replay_events(r, "belt_id", "ingest_seq").withColumnsRenamed({"belt_id": "key", "ingest_seq": "seq"})
    store = formula_store(spark, f"{checkpoint_dir(spark)}/models/{uuid.uuid4().hex}")
    a = J.read_routed(spark, _stream_job(spark, payloads, store), J.PREDICTIONS)
    return a.groupBy("belt_id", "risk", "health_band", "rul_band", "confidence_level", "prediction_status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("early_failure_flag").alias("n_early"), q4(F.avg("failure_risk_score")).alias("failure_risk_score"),
        F.round(F.avg("ml_health")).alias("ml_health"), F.round(F.avg("ml_rul_days")).alias("ml_rul_days"))


def stream_event_time(spark, sf):
    """STR-6: alerts of the job in event-time mode per belt and class; every event arrives up to 5 h 50 min late, the
    delay is 6 h, and a belt's events of its last 6 h still wait at the end."""
    from ..sources.stream import late_arrival, replay_events
    from ..streaming import job as J
    from ..streaming.event_time import EventTime
    arrival = late_arrival(F.col("ts"), 21_000)
    payloads = replay_events(readings(spark, sf), F.col("belt_id").alias("key"), arrival.alias("seq"))
    a = J.read_routed(spark, _stream_job(spark, payloads, event_time=EventTime(delay_s=21_600)), J.PREDICTIONS)
    return a.groupBy("belt_id", "risk", "health_band", "rul_band").agg(
        F.count(F.lit(1)).alias("n"), q4(F.min("degradation_index")).alias("min_degradation"), q4(F.max("degradation_index")).alias("max_degradation"),
        q4(F.avg("failure_risk_score")).alias("failure_risk_score"), q4(F.avg("degradation_index")).alias("degradation_index"))


def flagship(spark, sf):
    """Report per belt (safe mode): summary + operational risk + reasons +
    alert bands (bands classify the unrounded values; the emitted record
    of the stream path carries the 2-place rounding)."""
    r = _report(spark, sf, lambda d: S.safe_mode(d, TH))
    r = r.withColumns({"_h": F.col("final_health"), "_r": F.col("final_rul_days")})
    r = S.alert_bands(r, TH, "final_health", "final_rul_days")
    return r.select("belt_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ssxxx").alias("timestamp_utc"),
                    q4(F.col("_h")).alias("health_score"), q4(F.col("_r")).alias("rul_days"),
                    "confidence_level", "prediction_status", "risk_level", "risk", "health_band", "rul_band",
                    F.array_join("risk_reasons", ";").alias("risk_reasons"))


QUERIES = {
    "clean_coerce": clean_coerce,
    "dedup_last": dedup_last,
    "range_filter": range_filter,
    "minute_resample": minute_resample,
    "minute_grid_interpolated": minute_grid_interpolated,
    "sensor_coverage": sensor_coverage,
    **{name: _group_query(name) for name in GROUPS},
    "safe_mode_score": safe_mode_score,
    "prediction_smoothing": prediction_smoothing,
    "hybrid_fusion": hybrid_fusion,
    "quality_gate": quality_gate,
    "operational_risk": operational_risk,
    "risk_reasons": risk_reasons,
    "alert_bands": alert_bands,
    "latest_per_belt": latest_per_belt,
    "summary": summary,
    "quality_report": quality_report,
    "regression_metrics": regression_metrics,
    "segment_metrics": segment_metrics,
    "chrono_split": chrono_split,
    "features_roundtrip": features_roundtrip,
    "cv_folds": cv_folds,
    "cv_fold_rows": cv_fold_rows,
    "sample_weights": sample_weights,
    "upsample_counts": upsample_counts,
    "normalize_events": normalize_events,
    "stream_features_batch_form": stream_features_batch_form,
    "stream_alerts": stream_alerts,
    "topic_routing": topic_routing,
    "replay_rows": replay_rows,
    "train_score": train_score,
    "streaming_run": streaming_run,
    "streaming_alert_counts": streaming_alert_counts,
    "stream_routed": stream_routed,
    "stream_model_alerts": stream_model_alerts,
    "stream_event_time": stream_event_time,
    "batch_model_scores": batch_model_scores,
    "flagship_report": flagship,
}
