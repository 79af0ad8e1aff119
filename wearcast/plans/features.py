"""Batch feature table: clean -> minute grid -> wide -> windows -> scalars
-> condition state -> targets -> finalise.

Internal column names avoid `/` and `@` (`temp_6h_mean`, `ts`); use
`to_external` at the output edge for the reference's names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import WINDOWS, BeltMeta, Thresholds, external_feature_name
from ..functions import formulas as fx
from ..operators.clean import clean_readings
from ..operators.grid import DAY, minute_means, minute_ts, wide_grid
from ..operators.rolling import Spec, rolling_windows, std_from
from ..operators.scan import forward_back_fill
from ..session import materialize

KEYS = ["belt_id"]
SENSORS = ("temp", "elong", "curr")
SLOPE_SENSORS = ("temp", "elong")
SLOPE_WINDOWS = ("1h", "6h", "24h")


def belts_table(spark: SparkSession, belts: list[BeltMeta] | None = None) -> DataFrame:
    """JOI-2: belt dimension; its size is the number of configured belts."""
    if not belts:
        raise ValueError("belt metadata is needed for the targets")
    rows = [(b.belt_id, b.installation_date, b.replace_date) for b in belts]
    df = spark.createDataFrame(rows, "belt_id string, installation_date string, replace_date string")
    return df.select("belt_id",
                     F.to_timestamp("installation_date").alias("install_ts"),
                     F.to_timestamp("replace_date").alias("replace_ts"))


def window_specs(label: str) -> list[Spec]:
    specs = []
    for s in SENSORS:
        stats = ("n", "mean", "m2", "min", "max")
        if s in SLOPE_SENSORS and label in SLOPE_WINDOWS:
            stats = stats + ("slope",)
        specs.append(Spec(f"{s}_{label}", f"{s}_avg", stats))
    if label == "1h":
        specs.append(Spec("active_1h", "_active", ("n", "sum")))
    if label == "6h":
        specs.append(Spec("active_6h", "_active", ("n", "sum")))
        specs.append(Spec("high_6h", "high_load", ("n", "sum")))
    if label == "24h":
        specs.append(Spec("warnev_24h", "_warn_event", ("n", "sum")))
        specs.append(Spec("critev_24h", "_crit_event", ("n", "sum")))
    return specs


def wide_table(readings: DataFrame, th: Thresholds) -> DataFrame:
    """Cleaned readings -> gap-free wide minute table (belt_id, mi, *_avg).

    The observed minute bins are read by several branches (scan, ranges),
    so they are checkpointed once instead of being recomputed per branch.
    """
    means = materialize(minute_means(clean_readings(readings, th)))
    return materialize(wide_grid(means))


def rolling_features(wide: DataFrame, th: Thresholds) -> DataFrame:
    """WIN-1..8 on the wide minute table (batch dialect)."""
    df = wide.withColumns({
        "is_idle": fx.is_idle(F.col("curr_avg"), th),
        "high_load": fx.high_load(F.col("curr_avg"), th),
    }).withColumn("_active", F.lit(1) - F.col("is_idle"))
    flags = fx.threshold_flags(F.col("temp_avg"), F.col("elong_avg"), F.col("curr_avg"), th)
    df = df.withColumns(flags)
    df = df.withColumns({"warning_count": fx.warning_count(), "critical_count": fx.critical_count()})
    df = df.withColumns({"_warn_event": fx.flag(F.col("warning_count") > 0),
                         "_crit_event": fx.flag(F.col("critical_count") > 0)})

    df = df.withColumn("elong_delta", fx.elong_delta(F.col("elong_avg"), th))
    # one exchange for all window sizes and lags
    df = rolling_windows(df, KEYS, "mi", {w: window_specs(label) for label, w in WINDOWS.items()}, {
        "_elong_lag720": ("elong_avg", 720),
        "_delta_lag60": ("elong_delta", 60),
        "_elong_lag5": ("elong_avg", 5),
    })
    df = df.withColumns({f"{s}_{label}_std": F.coalesce(
        std_from(F.col(f"{s}_{label}_n"), F.col(f"{s}_{label}_m2"), 1), F.lit(0.0))
        for label in WINDOWS for s in SENSORS})

    z = F.lit(0.0)
    df = df.withColumns({
        "utilization_1h": F.col("active_1h_sum") / F.col("active_1h_n"),
        "utilization_6h": F.col("active_6h_sum") / F.col("active_6h_n"),
        "high_load_share_6h": F.col("high_6h_sum") / F.col("high_6h_n"),
        "current_percentile": F.when(
            F.col("curr_12h_n") >= 10,
            (F.col("curr_avg") - F.col("curr_12h_min"))
            / (F.col("curr_12h_max") - F.col("curr_12h_min") + F.lit(1e-6)) * F.lit(100.0)).otherwise(z),
        "current_volatility_6h": F.when(F.col("curr_6h_n") >= 10, F.col("curr_6h_std")).otherwise(z),
        "elong_volatility_6h": F.when(F.col("elong_6h_n") >= 10, F.col("elong_6h_std")).otherwise(z),
        "temp_variability_12h": F.when(F.col("temp_12h_n") >= 2, F.col("temp_12h_std")).otherwise(z),
        "warning_event_count_24h": F.col("warnev_24h_sum") / F.lit(60.0),
        "critical_event_count_24h": F.col("critev_24h_sum") / F.lit(60.0),
    })
    df = df.withColumns({
        f"{s}_trend_{label}": F.when(F.col(f"{s}_{label}_n") >= 10,
                                     F.coalesce(F.col(f"{s}_{label}_slope"), z)).otherwise(z)
        for s in SLOPE_SENSORS for label in SLOPE_WINDOWS})

    df = df.withColumns({
        "elong_rate_12h": F.coalesce(F.col("elong_avg") - F.col("_elong_lag720"), z),
        "elong_delta_rate": F.coalesce(F.col("elong_delta") - F.col("_delta_lag60"), z),
        "elong_micro_trend": F.coalesce(F.col("elong_avg") - F.col("_elong_lag5"), z),
    })
    drop = [c for c in df.columns if c.endswith(("_n", "_m2", "_sum", "_slope"))
            or c.startswith("_")]
    return df.drop(*drop)


def scalar_features(df: DataFrame, th: Thresholds, mode: str = "batch") -> DataFrame:
    """SCA-2..9 (needs the window columns)."""
    tr6 = F.col("elong_trend_6h")
    df = df.withColumns({
        "elong_accel_6h": F.coalesce(F.col("elong_trend_1h") - tr6, F.lit(0.0)),
        "temp_above_baseline": fx.temp_above_baseline(F.col("temp_avg"), th),
    })
    df = df.withColumns({
        "degradation_index": fx.degradation_index(F.col("elong_delta"), tr6,
                                                  F.col("elong_volatility_6h"), th, mode),
        "degradation_rising_flag": fx.degradation_rising_flag(tr6, F.col("elong_accel_6h")),
        "temp_spike_index": fx.temp_spike_index(F.col("temp_above_baseline"), F.col("temp_variability_12h")),
        "temp_elong_coupling": fx.temp_elong_coupling(F.col("temp_above_baseline"), tr6),
        "temp_elong_interaction": fx.temp_elong_interaction(F.col("temp_above_baseline"), F.col("elong_delta")),
        "temp_elong_risk_flag": fx.temp_elong_risk_flag(F.col("temp_above_baseline"), tr6),
    })
    return df


def condition_features(df: DataFrame) -> DataFrame:
    """SCA-12..15."""
    crit, warn = F.col("critical_count"), F.col("warning_count")
    deg, rising = F.col("degradation_index"), F.col("degradation_rising_flag")
    df = df.withColumn("condition_risk_score", fx.condition_risk_score(
        crit, warn, F.coalesce(deg, F.lit(0.0)), rising))
    df = df.withColumn("condition_state_code", fx.condition_state_code(
        crit, warn, deg, rising, F.col("elong_trend_6h"), F.col("temp_above_baseline"),
        F.col("condition_risk_score")))
    return df.withColumns({
        "is_failure": (F.col("condition_state_code") == 2).cast("int"),
        "condition_state": fx.state_name(F.col("condition_state_code")),
        "failure_proximity": fx.failure_proximity(deg, crit, warn),
        "failure_trigger": fx.failure_trigger(crit, deg),
    })


def target_features(df: DataFrame, belts: DataFrame, th: Thresholds) -> DataFrame:
    """SCA-16..20.  A belt without metadata fails the job; Spark picks the join
    by the size of the belt table."""
    df = df.join(belts, "belt_id", "left")
    df = df.withColumn("calendar_rul_days",
                       fx.calendar_rul_days(F.col("ts"), F.col("install_ts"), F.col("replace_ts")))
    df = df.withColumns({
        "target_health": fx.target_health(F.col("degradation_index"), F.col("warning_event_count_24h"),
                                          F.col("critical_event_count_24h")),
        "target_rul_days": fx.target_rul_days(F.col("calendar_rul_days"), F.col("degradation_index"),
                                              F.col("critical_event_count_24h"), th),
        "runtime_age_hours": fx.runtime_age_hours(F.col("ts"), F.col("install_ts")),
    })
    df = df.withColumn("is_critical", fx.is_critical(F.col("target_health"), F.col("critical_event_count_24h")))
    return df.drop("install_ts", "replace_ts")


def finalize(df: DataFrame, fill: bool = True) -> DataFrame:
    """SCA-21: +-inf/NaN -> null, forward then backward fill per belt, rest -> 0."""
    num = [f.name for f in df.schema.fields
           if f.dataType.typeName() in ("double", "float") and f.name not in ("mi",)]
    if fill:
        df = df.withColumns({c: fx.finite_or_null(F.col(c)) for c in num})
        df = df.withColumn("_day", F.floor(F.col("mi") / DAY).cast("long"))
        df = forward_back_fill(df, KEYS, "mi", num, "_day").drop("_day")
    ints = [f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long")
            and f.name != "mi"]
    return df.fillna(0.0, subset=num).fillna(0, subset=ints)


def any_gap(df: DataFrame) -> Column:
    """Aggregate: whether any numeric cell is null or not finite.  Where none is, SCA-21
    changes nothing, so its fill pass is left out."""
    gap = F.lit(False)
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            gap = gap | F.col(f.name).isNull() | F.isnan(f.name) | (F.abs(F.col(f.name)) == float("inf"))
    return F.max(gap)


def build_features(readings: DataFrame, spark: SparkSession, th: Thresholds | None = None,
                   belts: list[BeltMeta] | None = None, fill: bool = True,
                   means: DataFrame | None = None) -> DataFrame:
    """Whole batch feature job.  `means` (materialised minute bins) may be
    passed in when another job already produced them."""
    th = th or Thresholds()
    if means is None:
        wide = wide_table(readings, th)
    else:
        wide = materialize(wide_grid(means))
    wide = wide.withColumn("ts", minute_ts(F.col("mi")))
    df = rolling_features(wide, th)
    df = scalar_features(df, th, "batch")
    df = condition_features(df)
    df = target_features(df, belts_table(spark, belts), th)
    if not fill:
        return finalize(df, False)
    seen = Observation()                       # seen while the table is written, so it is not read again for it
    df = materialize(df.observe(seen, any_gap(df).alias("gap")))
    return materialize(finalize(df)) if seen.get["gap"] else finalize(df, False)


FEATURE_ORDER_HEAD = ["belt_id", "ts", "mi"]


def to_external(df: DataFrame) -> DataFrame:
    """Rename to the reference's column names (`@timestamp`, `<sensor>_1h_mean`)."""
    out = []
    for c in df.columns:
        if c == "ts":
            out.append(F.col("ts").alias("@timestamp"))
        else:
            out.append(F.col(c).alias(external_feature_name(c)))
    return df.select(*out)
