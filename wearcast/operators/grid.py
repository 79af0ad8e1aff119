"""Minute resampling, gap-free grid with linear interpolation, and the
long -> wide pivot (AGG-2, WIN-9, AGG-3, JOI-4).

The grid is built without a calendar join: every observed minute emits the
minutes up to the next observed one, and the
value at each emitted minute is interpolated between the nearest non-null
observations of that column (found with the chunked scan of `scan.py`).
A gap explodes into days, which are dealt out by (series, day), and a day into its
minutes; so neither an array nor a task grows with a gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CORE_SENSORS, SHORT
from .scan import carry_prev_next

DAY = 1440  # minutes per scan chunk


def minute_index(ts: Column) -> Column:
    """Epoch minute of a timestamp (left-closed minute bins)."""
    return F.floor(F.unix_micros(ts) / F.lit(60_000_000)).cast("long")


def minute_ts(mi: Column) -> Column:
    return F.timestamp_seconds(mi * 60)


def minute_means(readings: DataFrame, freq_minutes: int = 1) -> DataFrame:
    """AGG-2: mean of avg/min/max/std per (belt, sensor, bin); bins are
    left-closed `freq_minutes` wide.  Output keyed by integer `mi`."""
    mi = minute_index(F.col("ts"))
    if freq_minutes != 1:
        mi = F.floor(mi / freq_minutes).cast("long") * freq_minutes
    return (readings.withColumn("mi", mi)
            .groupBy("belt_id", "sensorid", "mi")
            .agg(F.avg("avg_value").alias("avg_value"),
                 F.avg("min_value").alias("min_value"),
                 F.avg("max_value").alias("max_value"),
                 F.avg("std_deviation").alias("std_deviation")))


def _interp(t: Column, p: str, n: str) -> Column:
    """Linear interpolation at `t` between prev struct `p` and next struct `n`
    (edges take the nearest value).  Same operation order as numpy.interp."""
    P, N = F.col(p), F.col(n)
    slope = (F.col(f"{n}.v") - F.col(f"{p}.v")) / (F.col(f"{n}.o") - F.col(f"{p}.o"))
    return (F.when(P.isNull(), F.col(f"{n}.v"))
             .when(t <= F.col(f"{p}.o"), F.col(f"{p}.v"))
             .when(N.isNull(), F.col(f"{p}.v"))
             .otherwise(slope * (t - F.col(f"{p}.o")) + F.col(f"{p}.v")))


def minute_grid(means: DataFrame, columns: tuple[str, ...] = ("avg_value", "min_value", "max_value"),
                with_std: bool = True, span: str = "sensor", step: int = 1) -> DataFrame:
    """WIN-9: gap-free grid per (belt, sensor).

    `span="sensor"` covers each sensor's own first..last bin (reference
    behaviour for the cleaned long table); `span="belt"` extends every
    sensor to the belt's overall range with edge values, which keeps the
    wide table gap-free.
    """
    keys = ["belt_id", "sensorid"]
    df = means.withColumn("_day", F.floor(F.col("mi") / DAY).cast("long"))
    cols = list(columns)
    scanned = carry_prev_next(df, keys, "mi", cols, "_day")
    # next observed bin (any column): avg_value is never null after cleaning
    nxt_obs = F.col("_n_avg_value.o") if "avg_value" in cols else None
    if span == "belt":
        rng = means.groupBy("belt_id").agg(F.min("mi").alias("_lo"), F.max("mi").alias("_hi"))
        scanned = scanned.join(rng, "belt_id", "left")
        first = means.groupBy(*keys).agg(F.min("mi").alias("_first"))
    else:
        rng = means.groupBy(*keys).agg(F.min("mi").alias("_lo"), F.max("mi").alias("_hi"))
        scanned = scanned.join(rng, keys, "left")
        first = None
    if first is not None:
        scanned = scanned.join(first, keys, "left")
        is_first = F.col("mi") == F.col("_first")
    else:
        is_first = F.col("mi") == F.col("_lo")
    start = F.when(is_first, F.col("_lo")).otherwise(F.col("mi"))
    end = F.coalesce(nxt_obs - step, F.col("_hi"))
    day, wide = F.col("_piece"), F.lit(step).cast("long")
    # bins are multiples of `step`: the first and the last one of the day
    lo = F.greatest(F.col("_from"), F.ceil(day * DAY / step).cast("long") * wide)
    hi = F.least(F.col("_to"), F.floor((day * DAY + DAY - 1) / step).cast("long") * wide)
    days = scanned.withColumns({"_from": start, "_to": end}).withColumn(
        "_piece", F.explode(F.sequence(F.floor(F.col("_from") / DAY).cast("long"), F.floor(F.col("_to") / DAY).cast("long"))))
    # a number of partitions of its own: these rows are few beside the minutes that come of them
    n = int(means.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    g = days.repartition(n, *keys, "_piece").where(lo <= hi).withColumn("t", F.explode(F.sequence(lo, hi, wide)))
    out = [F.col("belt_id"), F.col("sensorid"), F.col("t").alias("mi")]
    for c in cols:
        out.append(_interp(F.col("t"), f"_p_{c}", f"_n_{c}").alias(c))
    if with_std:
        out.append(F.when(F.col("t") == F.col("mi"), F.coalesce(F.col("std_deviation"), F.lit(0.0)))
                    .otherwise(F.lit(0.0)).alias("std_deviation"))
    return g.select(*out)


def pivot_wide(grid: DataFrame, value: str = "avg_value") -> DataFrame:
    """AGG-3: one row per (belt, minute), one column per core sensor
    (`temp_avg`, `elong_avg`, `curr_avg`).  The value list is fixed, so no
    distinct pass is needed to discover pivot values."""
    w = (grid.groupBy("belt_id", "mi").pivot("sensorid", CORE_SENSORS)
             .agg(F.first(value)))
    for s in CORE_SENSORS:
        w = w.withColumnRenamed(s, f"{SHORT[s]}_avg")
    return w


def wide_grid(means: DataFrame) -> DataFrame:
    """Gap-free wide table over each belt's overall range (edges filled)."""
    g = minute_grid(means, columns=("avg_value",), with_std=False, span="belt")
    return pivot_wide(g)
