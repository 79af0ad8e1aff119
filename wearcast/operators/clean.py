"""Cleaning operators: core-sensor filter, coercion, keep-last dedup, range
filter and sensor-coverage checks (PRJ-1..4, AGG-1, AGG-4, SET-3, JOI-1, JOI-5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CORE_SENSORS, Thresholds

READING_COLS = ["belt_id", "sensorid", "ts", "avg_value", "min_value", "max_value",
                "std_deviation", "ingest_seq"]


def core_sensor_filter(df: DataFrame) -> DataFrame:
    """PRJ-1: trim the sensor name, keep the three core sensors.  Also drops
    rows whose time or `avg_value` did not survive coercion (PRJ-2, PRJ-3)."""
    return (df.withColumn("sensorid", F.trim(F.col("sensorid")))
              .where(F.col("sensorid").isin(CORE_SENSORS))
              .where(F.col("ts").isNotNull() & F.col("avg_value").isNotNull()))


def dedup_keep_last(df: DataFrame) -> DataFrame:
    """AGG-1: per (belt, sensor, ts) keep the row that arrived last.

    One `max_by` per column: numbers as values and a number as order give
    fixed-width buffers, so this is a hash aggregate with a map-side step that
    reduces a hot key before the shuffle (a struct would be sorted instead).
    Arrival numbers are unique, so all columns come from the same row.
    """
    payload = [c for c in df.columns if c not in ("belt_id", "sensorid", "ts")]
    agg = df.groupBy("belt_id", "sensorid", "ts").agg(
        *[(F.max(c) if c == "ingest_seq" else F.max_by(c, "ingest_seq")).alias(c) for c in payload])
    return agg.select("belt_id", "sensorid", "ts", *payload)


def range_filter(df: DataFrame, th: Thresholds) -> DataFrame:
    """PRJ-4: keep `lo <= avg <= hi` (absent limit = +-inf).

    The limits come from the config, one literal pair per sensor, so the
    predicate is a closed CASE expression evaluated inside codegen: no join.
    """
    if not th.ranges:
        return df
    cond = None
    for s, (lo, hi) in th.ranges.items():
        lo_v = float("-inf") if lo is None else float(lo)
        hi_v = float("inf") if hi is None else float(hi)
        c = (F.col("sensorid") == s) & F.col("avg_value").between(lo_v, hi_v)
        cond = c if cond is None else (cond | c)
    others = ~F.col("sensorid").isin(list(th.ranges))
    return df.where(cond | others)


def clean_readings(df: DataFrame, th: Thresholds | None = None) -> DataFrame:
    """Full cleaning stage: sensor filter -> dedup keep-last -> range filter."""
    th = th or Thresholds()
    return range_filter(dedup_keep_last(core_sensor_filter(df)), th)


def sensor_coverage(df: DataFrame) -> DataFrame:
    """AGG-4 / SET-3 / JOI-5: per belt, which core sensors are present/missing.

    `collect_set` is bounded by the three core names (other names are
    filtered first), so no group can grow with the data.
    """
    core = F.array(*[F.lit(s) for s in CORE_SENSORS])
    g = (df.where(F.col("sensorid").isin(CORE_SENSORS))
           .groupBy("belt_id").agg(F.collect_set("sensorid").alias("_present")))
    missing = F.array_sort(F.array_except(core, F.col("_present")))
    return g.select(
        "belt_id",
        F.size("_present").alias("n_sensors_present"),
        missing.alias("missing_sensors"),
        (F.size(missing) == 0).alias("coverage_ok"),
    )


def assert_coverage(df: DataFrame) -> None:
    """Raise when belts lack a core sensor; all of them are named (one row per belt)."""
    bad = sensor_coverage(df).where(~F.col("coverage_ok")).orderBy("belt_id").collect()
    if bad:
        raise ValueError("Missing required sensors: "
                         + "; ".join(f"{r.belt_id}: {list(r.missing_sensors)}" for r in bad))
