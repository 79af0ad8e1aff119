"""Stream sources and records (SRC-4, SRC-5, SRC-8, SNK-2).

Kafka is the production transport; the connector jar is not bundled here.
`read_events_stream` reads it, or JSON-lines files whose payloads carry their
arrival number; `topics.py` reads topic folders by (partition, offset), all with
the same columns `value`, `topic`, `seq`.  The routed sinks are in
`streaming/job.py`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_TOPIC = "belt-data"
PRED_TOPIC = "belt-predictions"
PIPELINE_TAGS = {RAW_TOPIC: "belt-raw-data", PRED_TOPIC: "belt-predictions"}


def read_events_stream(spark: SparkSession, source: str, topics: list[str] | None = None,
                       bootstrap: str | None = None, max_files: int | None = None,
                       max_offsets: int = 200_000) -> DataFrame:
    """SRC-4: streaming DataFrame of raw payloads with an arrival key.

    * Kafka (`bootstrap` given): value as string, arrival = (partition, offset),
      offsets live in the query checkpoint (no consumer-group commit).
    * Files: each line is one payload; the arrival key is the `seq` field of
      the payload (replay jobs write it), null where it is no number.
    """
    topics = topics or [RAW_TOPIC]
    if bootstrap:
        k = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
             .option("subscribe", ",".join(topics)).option("startingOffsets", "earliest")
             .option("maxOffsetsPerTrigger", max_offsets).load())
        return k.select(F.col("value").cast("string").alias("value"), "topic",
                        (F.col("partition").cast("long") * F.lit(1 << 40) + F.col("offset")).alias("seq"))
    rs = spark.readStream.format("text")
    if max_files:
        rs = rs.option("maxFilesPerTrigger", max_files)
    lines = rs.load(source)
    return lines.select(F.col("value"), F.lit(topics[0]).alias("topic"),
                        F.get_json_object("value", "$.seq").try_cast("long").alias("seq"))


def tag_pipeline(df: DataFrame) -> DataFrame:
    """SRC-5: `pipeline` tag by source topic."""
    tag = None
    for topic, name in PIPELINE_TAGS.items():
        tag = F.when(F.col("topic") == topic, F.lit(name)) if tag is None else tag.when(F.col("topic") == topic, F.lit(name))
    return df.withColumn("pipeline", tag)


def kafka_records(df: DataFrame, key_col: str = "belt_id") -> DataFrame:
    """SNK-2: key = belt (default GLOBAL), value = JSON of the whole record."""
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("@timestamp")
    return df.select(F.coalesce(F.col(key_col), F.lit("GLOBAL")).cast("string").alias("key"),
                     F.to_json(F.struct(*[time if c == "ts" else F.col(c) for c in df.columns])).alias("value"))


def replay_events(readings: DataFrame, *keep: str) -> DataFrame:
    """SRC-8: each stored reading becomes one input payload
    (`belt_id`, `sensorid`, `@timestamp`, `avg_value`, plus the arrival `seq`)."""
    return readings.select(*keep, F.to_json(F.struct(
        F.col("belt_id"), F.col("sensorid"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("@timestamp"),
        F.col("avg_value"),
        F.col("ingest_seq").alias("seq"))).alias("value"))


def late_arrival(ts: Column, most_s: int) -> Column:
    """Second of arrival of an event that comes up to `most_s` seconds late, by a hash of its time."""
    return F.unix_seconds(ts) + F.pmod(F.xxhash64(ts), F.lit(most_s))


def parse_replayed(df: DataFrame) -> DataFrame:
    schema = "sensorid string, `@timestamp` string, avg_value double, seq long"
    p = df.select(F.from_json("value", schema).alias("e")).select("e.*")
    return p.select("sensorid", F.try_to_timestamp(F.col("`@timestamp`")).alias("ts"), "avg_value", "seq")


def write_replay(readings: DataFrame, path: str) -> None:
    """Backfill job: payload files for the file-stream source (the Kafka
    variant is `df.write.format("kafka")` on the same `value` column)."""
    replay_events(readings).write.mode("overwrite").text(path)
