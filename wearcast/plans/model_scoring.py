"""Scoring a table (PRJ-9, ML-11, ML-12, ML-17) or a stream (PRJ-10, ML-16) with a
saved pair of models.

Strict projection: every feature that the model was fitted on must be a column,
and none of a belt's cells may be null or not a number.  What cannot be scored
keeps its rows, with null predictions, low confidence and a status that says
why; one bad belt does not keep the others from being scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.formulas import clip, lit
from .score import KEYS, row_std_of, safe_mode, score_with_predictions

PREDICTED = ("ml_health_raw", "ml_rul_raw", "ml_health", "ml_rul_days", "final_health", "final_rul_days")


def unscored(df: DataFrame, status: str, error: str) -> DataFrame:
    """All rows with the columns of a scored table, without predictions."""
    return df.withColumns({
        **{c: F.lit(None).cast("double") for c in PREDICTED},
        "confidence_level": F.lit("LOW"), "prediction_status": F.lit(status), "prediction_error": F.lit(error),
        "failure_risk_score": F.lit(None).cast("double"), "anomaly_score": F.lit(None).cast("double"),
        "early_failure_flag": F.lit(None).cast("int")})


def score_table(df: DataFrame, models, th: Thresholds | None = None, ml_only: bool = False) -> DataFrame:
    """Scores the rows of a feature table; `models` is what `load_models` gives,
    None meaning that there is no model: safe mode, or nothing with ml_only."""
    th = th or Thresholds()
    if models is None:
        return unscored(df, "ml_only_model_unavailable", "no model") if ml_only else safe_mode(df, th)
    health, rul, meta = models
    feats = list(meta["features"])
    missing = [f for f in feats if f not in df.columns]
    if missing:
        return unscored(df, "fallback_feature_prep_failed", f"not in the table: {', '.join(missing)}")
    numbers = df.withColumns({f: F.col(f).try_cast("double") for f in feats})
    gap = F.lit(False)
    for f in feats:
        gap = gap | F.col(f).isNull() | F.isnan(f)
    bad = numbers.groupBy(*KEYS).agg(F.max(gap).alias("_gap"))          # one row per belt
    judged = numbers.join(bad, KEYS)
    whole, broken = judged.where("not _gap").drop("_gap"), judged.where("_gap").drop("_gap")
    first = health.transform(whole)
    # a pair without a scaler has no scaled vector to judge
    first = first.withColumn("_row_std", row_std_of("features") if "features" in first.columns else lit(1.0)) \
        .withColumnRenamed("prediction", "ml_health_pred").drop("_raw", "features")
    both = rul.transform(first).withColumnRenamed("prediction", "ml_rul_pred").drop("_raw", "features")
    scored = score_with_predictions(both, th, ml_only, row_std=F.col("_row_std"), log_target=meta.get("target_transform") == "log1p")
    out = unscored(broken, "fallback_feature_prep_failed", "null or not a number in a feature")
    return scored.select(*out.columns).unionByName(out)


def lenient_features(df: DataFrame, feats: list[str]) -> DataFrame:
    """PRJ-10: every model feature as a number; a missing or unreadable one is 0."""
    return df.withColumns({f: F.coalesce(F.col(f).try_cast("double"), lit(0.0)) if f in df.columns else lit(0.0) for f in feats})


def score_stream(df: DataFrame, models, th: Thresholds) -> DataFrame:
    """ML-16: rows of stream features with ml_health (blended), ml_rul_days (penalised),
    confidence, status, risk score and early flag.  A row whose features or predictions
    are not finite fails alone: health and RUL 0, status `failed`, confidence LOW, no risk
    score."""
    health, rul, meta = models
    feats, base = list(meta["features"]), th.baseline_rul_days
    own = df.columns
    known = lenient_features(df.withColumn("_own", F.struct(*own)), feats)
    bad = F.lit(False)
    for f in feats:
        bad = bad | F.isnan(f) | (F.abs(F.col(f)) == float("inf"))
    known = known.withColumn("_bad", bad).withColumns({f: F.when(F.isnan(f) | (F.abs(F.col(f)) == float("inf")), lit(0.0)).otherwise(F.col(f)) for f in feats})
    both = health.transform(known).withColumnRenamed("prediction", "_h")
    both = both.withColumn("_std", row_std_of("features") if "features" in both.columns else lit(1.0)).drop("_raw", "features")
    both = rul.transform(both).withColumnRenamed("prediction", "_r").drop("_raw", "features")
    o = lambda c: F.coalesce(F.col(f"_own.{c}").cast("double"), lit(0.0)) if c in own else lit(0.0)
    days = F.expm1("_r") if meta.get("target_transform") == "log1p" else F.col("_r")
    penalty = clip(lit(1.0) - (lit(0.08) * o("degradation_index") + lit(0.03) * o("warning_count") + lit(0.08) * o("critical_count")), 0.65, 1.0)
    both = both.withColumn("_rul", clip(days, 0.0, base) * penalty)
    both = both.withColumn("_health", clip(lit(0.7) * clip(F.col("_h"), 0.0, 100.0) + lit(0.3) * (lit(100.0) * F.col("_rul") / lit(base)), 0.0, 100.0))
    both = both.withColumn("_rul", clip(F.col("_rul"), 0.0, base))
    failed = F.col("_bad") | F.isnan("_h") | F.isnan("_r") | F.col("_h").isNull() | F.col("_r").isNull()
    sure = F.when((F.col("_rul") < 50) | (F.col("_health") < 40), F.lit("LOW")).when(F.col("_std") < 0.01, F.lit("MEDIUM")).otherwise(F.lit("HIGH"))
    risk = clip(lit(0.5) * o("critical_count") + lit(0.3) * o("warning_count") + lit(0.4) * o("degradation_index"), 0.0, 5.0)
    early = ((o("degradation_index") > 0.6) & (o("elong_trend_6h") > 0.01)).cast("int")
    return both.select(
        "_own.*", F.when(failed, lit(0.0)).otherwise(F.col("_health")).alias("ml_health"), F.when(failed, lit(0.0)).otherwise(F.col("_rul")).alias("ml_rul_days"),
        F.when(failed, F.lit("LOW")).otherwise(sure).alias("confidence_level"), F.when(failed, F.lit("failed")).otherwise(F.lit("ok")).alias("prediction_status"),
        F.when(failed, lit(0.0)).otherwise(risk).alias("failure_risk_score"), F.when(failed, F.lit(0)).otherwise(early).alias("early_failure_flag"))
