"""Stream event normaliser (PRJ-5..8, STR-5) as column expressions.

The raw value is parsed as `map<string,string>`: this keeps "key absent"
(-> default) apart from "key present but null" (-> drop the event), and a
non-object payload parses to null (-> bad record).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_BELT
from ..sources.readings import events_path, sensor_of_event

MAP = "map<string,string>"


def _has(m: Column, k: str) -> Column:
    return F.coalesce(F.map_contains_key(m, F.lit(k)), F.lit(False))


def _num(m: Column, k: str) -> tuple[Column, Column]:
    """(parsed value, failed) for a numeric field; failed = present but
    null or not a number (Python `float()` also accepts surrounding blanks)."""
    raw = m[k]
    parsed = F.trim(raw).try_cast("double")
    return parsed, _has(m, k) & parsed.isNull()


def parse_payload(value: Column) -> Column:
    return F.from_json(value, MAP)


def flagged(df: DataFrame, value_col: str = "value", fallback_ts: Column | None = None, keep_value: bool = False) -> DataFrame:
    """PRJ-5/6, STR-5: every event normalised, with `reason` why it is no reading (else null).

    Output: belt_id, sensorid, ts, avg_value, min_value, max_value,
    std_deviation, variance, median, reason (+ all input columns, the payload only
    with `keep_value`).
    """
    m = F.col("_m")
    belt_raw = F.when(~_has(m, "belt_id"), F.lit(DEFAULT_BELT)).when(m["belt_id"].isNull(), F.lit("None")) \
        .otherwise(F.trim(m["belt_id"]))
    belt = F.when(belt_raw == "", F.lit(DEFAULT_BELT)).otherwise(belt_raw)
    sensor = F.when(~_has(m, "sensorid"), F.lit("")).when(m["sensorid"].isNull(), F.lit("None")) \
        .otherwise(F.trim(m["sensorid"]))
    ts_txt = F.trim(m["@timestamp"])
    ts = F.coalesce(F.try_to_timestamp(ts_txt), fallback_ts if fallback_ts is not None else F.current_timestamp())

    avg, avg_bad = _num(m, "avg_value")
    std, std_bad = _num(m, "std_deviation")
    avg_v = F.when(_has(m, "avg_value"), avg).otherwise(F.lit(0.0))
    std_v = F.when(_has(m, "std_deviation"), std).otherwise(F.lit(0.0))
    mn, mn_bad = _num(m, "min_value")
    mx, mx_bad = _num(m, "max_value")
    var, var_bad = _num(m, "variance")
    med, med_bad = _num(m, "median")
    # a generator of one element: the optimizer copies no parse into the fields and filters above it
    out = df.select("*", F.explode(F.array(parse_payload(F.col(value_col)))).alias("_m")).select(
        "*",
        belt.alias("belt_id") if "belt_id" not in df.columns else belt.alias("_belt"),
        sensor.alias("_sensor"), ts.alias("_ts"), avg_v.alias("_avg"), std_v.alias("_std"),
        F.when(_has(m, "min_value"), mn).otherwise(avg_v - std_v).alias("_min"),
        F.when(_has(m, "max_value"), mx).otherwise(avg_v + std_v).alias("_max"),
        F.when(_has(m, "variance"), var).otherwise(std_v * std_v).alias("_var"),
        F.when(_has(m, "median"), med).otherwise(avg_v).alias("_med"),
        F.when(F.col("_m").isNull(), F.lit("no JSON object"))
         .when(avg_bad | std_bad | mn_bad | mx_bad | var_bad | med_bad, F.lit("a value is no number"))
         .when(F.col("ingest_seq").isNull() if "ingest_seq" in df.columns else F.lit(False), F.lit("no arrival number")).alias("reason"),
    )
    if "_belt" in out.columns:
        out = out.drop("belt_id").withColumnRenamed("_belt", "belt_id")
    return out.select(
        *[c for c in df.columns if c not in ("belt_id", "sensorid", "ts") and (keep_value or c != value_col)],
        "belt_id", F.col("_sensor").alias("sensorid"), F.col("_ts").alias("ts"),
        F.col("_avg").alias("avg_value"), F.col("_min").alias("min_value"), F.col("_max").alias("max_value"),
        F.col("_std").alias("std_deviation"), F.col("_var").alias("variance"), F.col("_med").alias("median"), "reason")


def good_only(seen: DataFrame) -> DataFrame:
    return seen.where("reason is null").drop("reason")


def normalize(df: DataFrame, value_col: str = "value", fallback_ts: Column | None = None) -> DataFrame:
    """One normalised row per good event; bad ones are left out."""
    return good_only(flagged(df, value_col, fallback_ts))


def bad_records(df: DataFrame, value_col: str = "value") -> DataFrame:
    """STR-5 side output: the payloads that are no readings, with the reason."""
    return flagged(df, value_col, keep_value=True).where("reason is not null").select(*df.columns, "reason")


def lenient_value(df: DataFrame, value_col: str = "value") -> DataFrame:
    """PRJ-8: the single-consumer path - a bad or missing avg_value is 0.0 and
    still stored; only non-object payloads are skipped."""
    m = parse_payload(F.col(value_col))
    return df.withColumn("_m", m).where(F.col("_m").isNotNull()).select(
        "*", F.coalesce(F.trim(F.col("_m")["avg_value"]).try_cast("double"), F.lit(0.0)).alias("avg_value"),
        F.coalesce(F.trim(F.col("_m")["sensorid"]), F.lit("")).alias("sensorid")).drop("_m")


# --------------------------------------------------------------------------
# JSON events derived from the driver's `events` table.  Every row becomes
# one payload; the row's own fields decide which normaliser path it takes:
#   k < 5        -> no belt_id key (default belt)      k = 5  -> blank belt_id
#   k >= 90      -> timestamp written with a +05:30 offset, else with Z
#   error events -> avg_value "x" (dropped)            signup with k < 50 -> avg_value null (dropped)
#   k >= 50      -> std_deviation present (k / 20), else absent (0.0)
#   odd k        -> sensor id padded with blanks (trimmed)
# --------------------------------------------------------------------------
def events_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(events_path(sf_dir))
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.col("ts").cast("timestamp")
    belt = F.concat(F.lit("belt-"), (F.col("user_id") % 4).cast("string"))
    sensor = sensor_of_event(F.col("event_type"))
    sensor_txt = F.when(k % 2 == 1, F.concat(F.lit("  "), sensor, F.lit(" "))).otherwise(sensor)
    ts_txt = F.when(k >= 90, F.concat(F.date_format(ts + F.expr("INTERVAL 5 HOURS 30 MINUTES"),
                                                    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+05:30"))) \
        .otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
    avg_txt = (F.when(F.col("event_type") == "error", F.lit('"x"'))
                .when((F.col("event_type") == "signup") & (k < 50), F.lit("null"))
                .otherwise(F.col("value").cast("string")))

    def kv(key: str, v: Column, quote: bool = True) -> Column:
        val = F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2) if quote else v
        return F.concat(F.lit(f'"{key}":'), val)

    parts = F.array(
        F.when(k >= 6, kv("belt_id", belt)).when(k == 5, F.lit('"belt_id":"  "')),
        kv("sensorid", sensor_txt),
        kv("@timestamp", ts_txt),
        kv("avg_value", avg_txt, quote=False),
        F.when(k >= 50, kv("std_deviation", (k / F.lit(20.0)).cast("string"), quote=False)),
    )
    payload = F.concat(F.lit("{"), F.concat_ws(",", F.filter(parts, lambda x: x.isNotNull())), F.lit("}"))
    return ev.select(F.col("event_id").alias("ingest_seq"), payload.alias("value"))
