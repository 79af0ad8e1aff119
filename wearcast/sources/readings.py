"""Batch sources of long-format sensor readings (SRC-1, SRC-2, SRC-3, adapter).

Every reader returns the same long schema::

    belt_id string, sensorid string, ts timestamp, avg_value double,
    min_value double, max_value double, std_deviation double, ingest_seq bigint

`ingest_seq` stands in for "file order": Spark has no row order, so the
keep-last dedup (AGG-1) needs an explicit sequence.  For files it is one number
made of the file's place by path, the split's first byte and the row; for topics
it is partition and offset; for the driver's `events` table it is `event_id`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CORE_SENSORS, CURRENT_SENSOR, DEFAULT_BELT, ELONG_SENSOR, TEMP_SENSOR

REQUIRED_COLUMNS = ["sensorid", "@timestamp", "avg_value"]
OPTIONAL_COLUMNS = ["min_value", "max_value", "std_deviation"]
NUMERIC_COLUMNS = ["avg_value", "min_value", "max_value", "std_deviation"]

READINGS_SCHEMA = T.StructType([
    T.StructField("belt_id", T.StringType()),
    T.StructField("sensorid", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("avg_value", T.DoubleType()),
    T.StructField("min_value", T.DoubleType()),
    T.StructField("max_value", T.DoubleType()),
    T.StructField("std_deviation", T.DoubleType()),
    T.StructField("ingest_seq", T.LongType()),
])


def validate_columns(columns: list[str]) -> None:
    """SRC-2: raise before planning if a required column is absent."""
    missing = [c for c in REQUIRED_COLUMNS if c not in columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def to_double(c: Column) -> Column:
    """PRJ-3: lenient numeric parse; bad text -> null, NaN -> null, inf survives."""
    s = F.trim(c.cast("string"))
    v = s.try_cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def to_utc_timestamp_lenient(c: Column) -> Column:
    """PRJ-2: ISO-8601 text (any offset or `Z`) -> UTC timestamp; bad -> null."""
    s = F.trim(c.cast("string"))
    return F.coalesce(
        F.try_to_timestamp(s),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS]XXX")),
    )


def read_sensor_csv(spark: SparkSession, path: str, belt_id: str | None = None) -> DataFrame:
    """SRC-1: header CSV of raw readings.

    Lines with more fields than the header are dropped; short lines are kept
    with missing fields null (they are dropped later if `avg_value` is null).
    All columns are read as strings and coerced with `try_cast`, so one bad
    cell never fails the job.
    """
    header = spark.read.option("header", True).csv(path).columns
    validate_columns(header)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header]
                          + [T.StructField("_corrupt", T.StringType())])
    raw = (spark.read.option("header", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt").schema(schema).csv(path))
    n_fields = len(header)
    too_long = F.col("_corrupt").isNotNull() & (F.size(F.split(F.regexp_replace("_corrupt", '"([^"]|"")*"', ""), ",")) > n_fields)
    raw = raw.where(~too_long | F.col("_corrupt").isNull())
    belt = F.col("belt_id") if "belt_id" in header else F.lit(belt_id or DEFAULT_BELT)
    cols = {c: (F.col(f"`{c}`") if c in header else F.lit(None)) for c in OPTIONAL_COLUMNS}
    # arrival order: file by path, split by its first byte, then row; a partition's splits
    # hold fewer rows than bytes, so the splits of a file cannot reach into each other
    files = sorted(raw.inputFiles())
    if len(files) >= 1 << 20:
        raise ValueError("at most 2^20 files are read in one order of arrival")
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    ranks = spark.createDataFrame(list(zip(files, range(len(files)), strict=True)), "path string, _file long").select(same("path").alias("_path"), "_file")
    place = F.col("_block") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    raw = raw.select("*", same(F.col("_metadata.file_path")).alias("_path"), F.col("_metadata.file_block_start").alias("_block")) \
        .withColumn("_place", place).join(ranks, "_path", "left")
    rank = F.when(F.col("_file").isNull(), F.raise_error(F.concat(F.lit("unknown input file "), "_path")).cast("long")).otherwise(F.col("_file"))
    return raw.select(
        belt.cast("string").alias("belt_id"),
        F.col("sensorid").alias("sensorid"),
        to_utc_timestamp_lenient(F.col("`@timestamp`")).alias("ts"),
        to_double(F.col("avg_value")).alias("avg_value"),
        *[to_double(cols[c]).alias(c) for c in OPTIONAL_COLUMNS],
        (rank * F.lit(1 << 43) + F.col("_place")).alias("ingest_seq"),
    )


# ---------------------------------------------------------------------------
# Adapter from the driver's `events` table (see FIXTURES.md §2).
# Fixed mapping: view -> temperature, click -> elongation, purchase -> current;
# belt = user_id mod 4; elongation = 250 + value.  Optional columns come from
# the `k` field of `props`: min/max = avg -/+ k/10 (min null when k < 10),
# std = k/20.  Other event types are dropped by the core-sensor filter.
# ---------------------------------------------------------------------------

EVENT_SENSOR = {"view": TEMP_SENSOR, "click": ELONG_SENSOR, "purchase": CURRENT_SENSOR}


def events_path(sf_dir: str) -> str:
    return f"{sf_dir.rstrip('/')}/events.parquet"


def sensor_of_event(c: Column) -> Column:
    expr = None
    for k, v in EVENT_SENSOR.items():
        expr = (F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v)))
    return expr.otherwise(F.col("event_type"))


def read_events_as_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long readings from `events.parquet`; unknown event types pass through as
    their own (non-core) sensor names so the core-sensor filter has work."""
    ev = spark.read.parquet(events_path(sf_dir))
    k = F.get_json_object("props", "$.k").cast("int")
    sensor = sensor_of_event(F.col("event_type"))
    avg = F.when(F.col("event_type") == "click", F.lit(250.0) + F.col("value")).otherwise(F.col("value"))
    return ev.select(
        F.concat(F.lit("belt-"), (F.col("user_id") % 4).cast("string")).alias("belt_id"),
        sensor.alias("sensorid"),
        F.col("ts").cast("timestamp").alias("ts"),
        avg.alias("avg_value"),
        F.when(k >= 10, avg - k / F.lit(10.0)).alias("min_value"),
        (avg + k / F.lit(10.0)).alias("max_value"),
        (k / F.lit(20.0)).alias("std_deviation"),
        F.col("event_id").alias("ingest_seq"),
    )


def with_replayed_duplicates(readings: DataFrame) -> DataFrame:
    """Dedup fixture: every reading arrives twice; the copy carries value + 1.

    The copy is the later arrival when the value is at least 50 and the
    earlier one otherwise, so keep-last must pick per key - over all rows.
    """
    offset = F.lit(1_000_000_000_000)
    copy = readings.select(
        "belt_id", "sensorid", "ts",
        (F.col("avg_value") + 1).alias("avg_value"),
        "min_value", "max_value", "std_deviation",
        F.when(F.col("avg_value") >= 50, F.col("ingest_seq") + offset)
         .otherwise(F.col("ingest_seq") - offset).alias("ingest_seq"),
    )
    return readings.unionByName(copy)


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: reload a stored feature/cleaned table; drop rows without a time."""
    df = spark.read.parquet(path)
    if "ts" in df.columns:
        df = df.where(F.col("ts").isNotNull())
    return df

