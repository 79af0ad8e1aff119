"""Scalar feature formulas as reusable Column functions (SCA-1..21).

Batch and stream share every formula; where they differ a `mode`
argument ("batch" | "stream") selects the variant.  Operation order
follows the reference so floating-point results agree.

Null rule: `clip` returns null for null (like pandas), whereas Spark's
`greatest/least` would skip the null; comparisons with null give null and
flags are coalesced to 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CURRENT_SENSOR, ELONG_SENSOR, TEMP_SENSOR, Thresholds

STATE_NAMES = {2: "CRITICAL", 1: "WARNING", 0: "NORMAL"}

# Checksum rounding grid for summarised outputs: round(x * QK) / QK.  A
# non-decimal step keeps "nice" decimal means (0.03125, 252.37125 ...) off
# the rounding ties where engines' last-bit differences would flip them.
QK = 9973.3


def lit(x) -> Column:
    return F.lit(float(x))


def clip(c: Column, lo=None, hi=None) -> Column:
    """Null-safe clip: null stays null."""
    out = c
    if lo is not None:
        out = F.greatest(out, lit(lo))
    if hi is not None:
        out = F.least(out, lit(hi))
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(out)


def flag(cond: Column) -> Column:
    return F.coalesce(cond.cast("int"), F.lit(0))


def col(name: str) -> Column:
    return F.col(name)


# --- SCA-1 ------------------------------------------------------------------
def is_idle(curr: Column, th: Thresholds) -> Column:
    return flag(curr < lit(th.idle_current))


def high_load(curr: Column, th: Thresholds) -> Column:
    return flag(curr >= lit(th.high_load))


# --- SCA-2, SCA-3 -------------------------------------------------------------
def elong_delta(elong: Column, th: Thresholds) -> Column:
    return elong - lit(th.baseline_elong)


def temp_above_baseline(temp: Column, th: Thresholds) -> Column:
    return clip(temp - lit(th.baseline_temp), 0.0)


# --- SCA-4, SCA-5 -------------------------------------------------------------
def trend_norm(trend_6h: Column) -> Column:
    return clip(trend_6h / lit(0.03), 0.0, 2.0)


def degradation_index(delta: Column, trend_6h: Column, vol_6h: Column, th: Thresholds,
                      mode: str = "batch") -> Column:
    span = th.elong_span if mode == "batch" else 30.0
    delta_norm = clip(delta / lit(span), 0.0, 2.0)
    vol_norm = clip(vol_6h / lit(6.0), 0.0, 2.0)
    return clip(lit(0.55) * delta_norm + lit(0.30) * trend_norm(trend_6h) + lit(0.15) * vol_norm, 0.0, 2.0)


def degradation_rising_flag(trend_6h: Column, accel_6h: Column) -> Column:
    return flag((trend_6h > lit(0.01)) | (accel_6h > lit(0.005)))


# --- SCA-6..9 -------------------------------------------------------------------
def temp_spike_index(tab: Column, var_12h: Column) -> Column:
    return clip(tab / lit(20.0) + var_12h / lit(8.0), 0.0, 3.0)


def temp_elong_coupling(tab: Column, trend_6h: Column) -> Column:
    return clip(tab / lit(25.0) * trend_norm(trend_6h), 0.0, 3.0)


def temp_elong_interaction(tab: Column, delta: Column) -> Column:
    return tab * clip(delta, 0.0)


def temp_elong_risk_flag(tab: Column, trend_6h: Column) -> Column:
    return flag((tab >= lit(15.0)) & (trend_6h > lit(0.01)))


# --- SCA-10, SCA-11 ---------------------------------------------------------------
def threshold_flags(temp: Column, elong: Column, curr: Column, th: Thresholds) -> dict[str, Column]:
    return {
        "temp_warning": flag(temp >= lit(th.warn(TEMP_SENSOR))),
        "temp_critical": flag(temp >= lit(th.crit(TEMP_SENSOR))),
        "elong_warning": flag(elong >= lit(th.warn(ELONG_SENSOR))),
        "elong_critical": flag(elong >= lit(th.crit(ELONG_SENSOR))),
        "current_warning": flag(curr >= lit(th.warn(CURRENT_SENSOR))),
        "current_critical": flag(curr >= lit(th.crit(CURRENT_SENSOR))),
    }


def warning_count() -> Column:
    return col("temp_warning") + col("elong_warning") + col("current_warning")


def critical_count() -> Column:
    return col("temp_critical") + col("elong_critical") + col("current_critical")


# --- SCA-12, SCA-13 -----------------------------------------------------------------
def condition_risk_score(crit: Column, warn: Column, deg: Column, rising: Column) -> Column:
    return clip(lit(0.55) * crit + lit(0.20) * warn + lit(0.35) * deg + lit(0.20) * rising, 0.0, 4.0)


def condition_state_code(crit: Column, warn: Column, deg: Column, rising: Column,
                         trend_6h: Column, tab: Column, score: Column) -> Column:
    deg0 = F.coalesce(deg, lit(0.0))
    tr0 = F.coalesce(trend_6h, lit(0.0))
    tab0 = F.coalesce(tab, lit(0.0))
    sustained = (crit >= 2) & ((deg0 >= 0.80) | (tr0 > 0.01) | (tab0 >= 15.0))
    early = (warn >= 1) | (deg0 >= 0.45) | (F.coalesce(rising, F.lit(0)) >= 1) | (tr0 > 0.005)
    critical = sustained | (F.coalesce(score >= 2.20, F.lit(False)))
    warning = early | F.coalesce(score >= 0.80, F.lit(False))
    return F.when(critical, F.lit(2)).when(warning, F.lit(1)).otherwise(F.lit(0))


def state_name(code: Column) -> Column:
    return (F.when(code == 2, F.lit(STATE_NAMES[2])).when(code == 1, F.lit(STATE_NAMES[1]))
             .otherwise(F.lit(STATE_NAMES[0])))


# --- SCA-14, SCA-15 ---------------------------------------------------------------
def failure_proximity(deg: Column, crit: Column, warn: Column) -> Column:
    return clip(F.coalesce(deg, lit(0.0)) + lit(0.5) * crit + lit(0.2) * warn, 0.0, 5.0)


def failure_trigger(crit: Column, deg: Column) -> Column:
    return flag((crit >= 2) & (F.coalesce(deg, lit(0.0)) >= 0.8))


# --- SCA-16..20 -----------------------------------------------------------------
def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / lit(86_400_000_000)


def calendar_rul_days(ts: Column, install: Column, replace: Column) -> Column:
    """Both dates must be known: without them greatest() would give one day."""
    lifecycle = F.greatest(days_between(replace, install), lit(1.0))
    raw = clip(days_between(replace, ts), 0.0)
    known = install.isNotNull() & replace.isNotNull()
    return F.when(known, F.coalesce(F.least(raw, lifecycle), lifecycle)).otherwise(
        F.raise_error(F.lit("belt without installation or replacement date")).cast("double"))


def target_health(deg: Column, warn24: Column, crit24: Column) -> Column:
    d = F.coalesce(deg, lit(0.0))
    return clip(lit(100.0) - clip(d, 0.0, 2.0) * lit(80.0) - F.coalesce(warn24, lit(0.0)) * lit(2.0)
                - F.coalesce(crit24, lit(0.0)) * lit(5.0), 0.0, 100.0)


def target_rul_days(calendar: Column, deg: Column, crit24: Column, th: Thresholds) -> Column:
    d = F.coalesce(deg, lit(0.0))
    mult = lit(1.0) - clip(d, 0.0, 1.0)
    return clip(calendar * mult - F.coalesce(crit24, lit(0.0)) * lit(50.0), 0.0, th.baseline_rul_days)


def is_critical(target_h: Column, crit24: Column) -> Column:
    return flag((target_h < 30.0) | (F.coalesce(crit24, lit(0.0)) > 0.0))


def runtime_age_hours(ts: Column, install: Column) -> Column:
    return clip((F.unix_micros(ts) - F.unix_micros(install)) / lit(3_600_000_000), 0.0)


def finite_or_null(c: Column) -> Column:
    """SCA-21 first step: +-inf and NaN -> null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast("double")).otherwise(c)
