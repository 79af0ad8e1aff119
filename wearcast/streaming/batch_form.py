"""Streaming semantics evaluated as one batch job (WIN-12..15, JOI-3, STR-2,
STR-4, ML-15, SRC-5): the oracle for the stateful streaming query.

Per (belt, sensor) the readings get an arrival ordinal; the trailing
windows over the last 60/360/720/1440 *readings* use the block kernel on
that ordinal; an as-of carry then gives every event the latest statistics
of each sensor.  Everything after the alignment is the same column
arithmetic the streaming query applies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CORE_SENSORS, SHORT, WINDOWS, Thresholds
from ..functions import formulas as fx
from ..operators.rolling import Spec, rolling_windows, std_from
from ..operators.scan import carry_prev_next, sequence_index
from ..plans.features import scalar_features
from ..plans.score import alert_bands
from ..session import materialize
from ..sources.readings import read_events_as_readings

SEQ_CHUNK = 65536
READY = 30
STAT_SENSORS = ("temp", "elong", "curr")


def reading_stats(readings: DataFrame, th: Thresholds) -> DataFrame:
    """Per core reading: trailing stats over that sensor's own readings."""
    core = readings.where(F.col("sensorid").isin(CORE_SENSORS)).select(
        "belt_id", "sensorid", "ingest_seq", "ts", F.col("avg_value").alias("v"))
    core = core.withColumn("_chunk", F.floor(F.col("ingest_seq") / SEQ_CHUNK))
    core = sequence_index(core, ["belt_id", "sensorid"], ["ingest_seq"], "_chunk", "ord").drop("_chunk")
    core = core.withColumns({
        "_active": fx.flag(F.col("v") >= fx.lit(th.idle_current)),
        "_high": fx.flag(F.col("v") >= fx.lit(th.high_load)),
    })
    keys = ["belt_id", "sensorid"]
    specs = {w: [Spec(f"w{lbl}", "v", ("n", "mean", "m2", "min", "max", "slope"))] for lbl, w in WINDOWS.items()}
    specs[WINDOWS["1h"]].append(Spec("act_1h", "_active", ("n", "sum")))
    specs[WINDOWS["6h"]] += [Spec("act_6h", "_active", ("n", "sum")), Spec("high_6h", "_high", ("n", "sum"))]
    # WIN-13: stream lags are one shorter than batch (arr[-k] is k-1 back)
    x = rolling_windows(core, keys, "ord", specs, {"lag719": ("v", 719), "lag59": ("v", 59), "lag4": ("v", 4)})
    stats = {}
    for lbl in WINDOWS:
        p = f"w{lbl}"
        stats[f"{p}_std"] = F.when(F.col(f"{p}_n") > 1, std_from(F.col(f"{p}_n"), F.col(f"{p}_m2"), 0)).otherwise(F.lit(0.0))
        stats[f"{p}_trend"] = F.when(F.col(f"{p}_n") >= 2, F.coalesce(F.col(f"{p}_slope"), F.lit(0.0))).otherwise(F.lit(0.0))
    for lbl in ("1h", "6h"):
        stats[f"util_{lbl}"] = F.col(f"act_{lbl}_sum") / F.col(f"act_{lbl}_n")
    stats["high_share_6h"] = F.col("high_6h_sum") / F.col("high_6h_n")
    return x.withColumns(stats).select(*keys, "ingest_seq", "ts", *STAT_FIELDS)


STAT_FIELDS = (["v", "ord"] + [f"w{lbl}_{s}" for lbl in WINDOWS for s in ("mean", "std", "min", "max", "trend")]
               + ["util_1h", "util_6h", "high_share_6h", "lag719", "lag59", "lag4"])


def align(events: DataFrame, stats: DataFrame) -> DataFrame:
    """JOI-3: each event (any sensor) sees the latest stats of every sensor."""
    ev = events.select("belt_id", "sensorid", "ingest_seq", "ts")
    st = stats.select("belt_id", "sensorid", "ingest_seq", F.struct(*STAT_FIELDS).alias("_s"))
    # the carry reads the table twice: the statistics are made once
    joined = materialize(ev.join(st, ["belt_id", "sensorid", "ingest_seq"], "left"), name="aligned")
    cols = {}
    for s in CORE_SENSORS:
        cols[f"_S_{SHORT[s]}"] = F.when(F.col("sensorid") == s, F.col("_s"))
    joined = joined.withColumns(cols).drop("_s").withColumn("_chunk", F.floor(F.col("ingest_seq") / SEQ_CHUNK))
    names = [f"_S_{x}" for x in STAT_SENSORS]
    a = carry_prev_next(joined, ["belt_id"], "ingest_seq", names, "_chunk", nxt=False)
    return a.select("belt_id", "sensorid", "ingest_seq", "ts",
                    *[F.col(f"_p_{n}.v").alias(n[3:]) for n in names])


def stream_feature_columns(a: DataFrame, th: Thresholds, keep: Column | None = None) -> DataFrame:
    """Stream dialect of the feature formulas on aligned stats (88 names,
    internal spelling); rows before the readiness gate are dropped, but for those of `keep`."""
    z = F.lit(0.0)
    cols = {}
    for s in STAT_SENSORS:
        cols[f"{s}_avg"] = F.col(f"{s}.v")
        cols[f"{s}_cnt"] = F.col(f"{s}.ord") + 1
        for lbl in WINDOWS:
            for st in ("mean", "std", "min", "max"):
                cols[f"{s}_{lbl}_{st}"] = F.col(f"{s}.w{lbl}_{st}")
    df = a.withColumns(cols)
    ready = (F.col("temp_cnt") >= READY) & (F.col("elong_cnt") >= READY) & (F.col("curr_cnt") >= READY)
    ready = F.coalesce(ready, F.lit(False))
    df = df.where(ready if keep is None else ready | keep)
    curr, elong = F.col("curr_avg"), F.col("elong_avg")
    df = df.withColumns({
        "is_idle": fx.is_idle(curr, th), "high_load": fx.high_load(curr, th),
        "utilization_1h": F.col("curr.util_1h"), "utilization_6h": F.col("curr.util_6h"),
        "high_load_share_6h": F.col("curr.high_share_6h"),
        "current_percentile": (curr - F.col("curr_12h_min")) / (F.col("curr_12h_max") - F.col("curr_12h_min")
                                                                 + F.lit(1e-6)) * F.lit(100.0),
        "elong_rate_12h": F.coalesce(elong - F.col("elong.lag719"), z),
        "elong_delta": fx.elong_delta(elong, th),
        "elong_delta_rate": F.coalesce(elong - F.col("elong.lag59"), z),
        "elong_micro_trend": F.coalesce(elong - F.col("elong.lag4"), z),
        "elong_trend_1h": F.col("elong.w1h_trend"), "elong_trend_6h": F.col("elong.w6h_trend"),
        "elong_trend_24h": F.col("elong.w24h_trend"),
        "temp_trend_1h": F.col("temp.w1h_trend"), "temp_trend_6h": F.col("temp.w6h_trend"),
        "temp_trend_24h": F.col("temp.w24h_trend"),
        "elong_volatility_6h": F.col("elong_6h_std"), "current_volatility_6h": F.col("curr_6h_std"),
        "temp_variability_12h": F.col("temp_12h_std"),
    })
    df = scalar_features(df, th, mode="stream")
    df = df.withColumns(fx.threshold_flags(F.col("temp_avg"), elong, curr, th))
    df = df.withColumns({"warning_count": fx.warning_count(), "critical_count": fx.critical_count()})
    df = df.withColumns({
        "failure_proximity": fx.failure_proximity(F.col("degradation_index"), F.col("critical_count"),
                                                  F.col("warning_count")),
        "failure_trigger": fx.failure_trigger(F.col("critical_count"), F.col("degradation_index")),
    })
    return df.drop("temp", "elong", "curr")


def stream_safe_mode(df: DataFrame, th: Thresholds) -> DataFrame:
    """ML-15: calendar RUL is never a stream feature, so the base is the
    baseline; risk score = clip(2 * degradation, 0, 5)."""
    base = th.baseline_rul_days
    deg = F.coalesce(F.col("degradation_index"), F.lit(0.0))
    penalty = fx.lit(1.0) - fx.clip(fx.lit(0.15) * deg + fx.lit(0.05) * F.col("warning_count"), 0.0, 0.5)
    final_rul = fx.clip(fx.lit(base) * penalty, 0.0, base)
    return df.withColumns({
        "ml_rul_days": final_rul,
        "ml_health": fx.lit(100.0) * (final_rul / fx.lit(base)),
        "confidence_level": F.lit("MEDIUM"), "prediction_status": F.lit("safe_mode_calendar"),
        "failure_risk_score": fx.clip(deg * fx.lit(2.0), 0.0, 5.0),
        "early_failure_flag": F.lit(0),
    })


def enrich(df: DataFrame, th: Thresholds, extra: list[str] | None = None) -> DataFrame:
    """ML-20 + STR-4: alert bands and the output record of one event."""
    a = alert_bands(df, th, "ml_health", "ml_rul_days")
    return a.select(*(extra or []),"belt_id", "sensorid", "ts", "ingest_seq", "ml_health", "ml_rul_days", "risk", "health_band",
                    "rul_band", "is_alert", F.col("is_critical_alert").alias("is_critical"),
                    F.col("is_warning_alert").alias("is_warning"), "confidence_level", "prediction_status",
                    "failure_risk_score", "early_failure_flag", "degradation_index")


def stream_features(spark: SparkSession, sf: str, th: Thresholds | None = None) -> DataFrame:
    return features_of(read_events_as_readings(spark, sf), th or Thresholds())


def features_of(readings: DataFrame, th: Thresholds) -> DataFrame:
    """The stream features of any readings."""
    return stream_feature_columns(align(readings, reading_stats(readings, th)), th)


def stream_alerts(spark: SparkSession, sf: str, th: Thresholds | None = None) -> DataFrame:
    th = th or Thresholds()
    return stream_alerts_from(stream_features(spark, sf, th), th)


def stream_alerts_from(f: DataFrame, th: Thresholds) -> DataFrame:
    """Alert records with the unrounded health/RUL kept for checks (the
    emitted stream record carries the 2-place rounded values)."""
    s = stream_safe_mode(f, th).withColumns({"_h": F.col("ml_health"), "_r": F.col("ml_rul_days")})
    out = enrich(s, th, extra=["_h", "_r"])
    return out.drop("ml_health", "ml_rul_days").withColumnsRenamed({"_h": "ml_health", "_r": "ml_rul_days"})


def topic_routing_counts(spark: SparkSession, sf: str, alerts: DataFrame | None = None) -> DataFrame:
    """SRC-5 + SNK-3: raw readings and predictions tagged by topic, then
    routed per tag; counted per (pipeline, belt)."""
    from ..sources.stream import tag_pipeline

    raw = read_events_as_readings(spark, sf).where(F.col("sensorid").isin(CORE_SENSORS)).select(
        F.lit("belt-data").alias("topic"), "belt_id")
    preds = (alerts if alerts is not None else stream_alerts(spark, sf)).select(F.lit("belt-predictions").alias("topic"), "belt_id")
    both = tag_pipeline(raw.unionByName(preds))
    return both.groupBy("pipeline", "belt_id").agg(F.count(F.lit(1)).alias("n"))
