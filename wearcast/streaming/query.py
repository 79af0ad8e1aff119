"""The streaming query (STR-1..8): payloads -> normaliser -> per-belt ring
buffers (`applyInPandasWithState`) -> stream features -> safe-mode score
-> alert bands -> sink, with a checkpoint for offsets and state.

The stateful step is the only Python on executors: per belt and trigger it
appends the events' values to the buffers of their sensors (at most 1440
values) and computes the window statistics over history and new values, a bounded
piece of the events at a time, one row per event once every sensor has 30 values.  All formulas after it are the shared Column functions.
"""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..config import CORE_SENSORS, DEFAULT_BELT, SHORT, WINDOWS, Thresholds
from ..operators.rolling import block_windows
from ..session import checkpoint_dir
from ..sources.stream import RAW_TOPIC, replay_events
from ..sources.topics import append_topic, read_topics
from .batch_form import READY, STAT_FIELDS, STAT_SENSORS, enrich, stream_feature_columns, stream_safe_mode
from .normalize import normalize

MAXLEN = 1440
TRIGGER = 500_000  # payloads that one trigger takes of a replayed table

_stat_types = {"v": "double", "ord": "long"}
STATS_SCHEMA = ", ".join(
    ["belt_id string", "sensorid string", "ingest_seq long", "ts timestamp"]
    + [f"{s}_{f} {_stat_types.get(f, 'double')}" for s in STAT_SENSORS for f in STAT_FIELDS])
STATE_SCHEMA = "temp array<double>, elong array<double>, curr array<double>, total long"


NAMES = {SHORT[s]: s for s in CORE_SENSORS}
PIECE = 65_536  # events of a belt whose statistics are held at once
FRAME = 8_192   # rows of a frame that the step gives out


def window_table(history: np.ndarray, new: np.ndarray, idle: float, high: float) -> dict[str, np.ndarray]:
    """Statistics of one sensor's buffer before the first and after each of the
    `new` values (len(new) + 1 rows); a row without any value is NaN."""
    seen = np.concatenate([history, new]).astype(float)
    end = len(history) + np.arange(len(new) + 1)            # values seen at each row
    last = np.concatenate([np.full(MAXLEN, np.nan), seen])  # value `k` places back: last[end + MAXLEN - k]
    out = {"v": last[end + MAXLEN - 1], "ord": np.minimum(end, MAXLEN) - 1}
    some = end > 0
    held = np.arange(-(-max(len(seen), 1) // MAXLEN) * MAXLEN) < len(seen)
    y = np.zeros((3, len(held)))
    y[:, :len(seen)] = seen, seen >= idle, seen >= high
    valid = np.broadcast_to(held, y.shape)

    def rows(found: np.ndarray) -> np.ndarray:
        filled = np.full(len(end), np.nan)
        filled[some] = found
        return filled

    with np.errstate(invalid="ignore"):                     # a value that is not finite shows in its windows
        for lbl, w in WINDOWS.items():
            at = end[some] - 1
            found = {k: v[0] for k, v in block_windows(y[:1], valid[:1], w, {"mean", "m2", "min", "max", "slope"}, at).items()}
            found["std"], found["trend"] = np.sqrt(found["m2"] / found["n"]), found["slope"]
            out.update({f"w{lbl}_{k}": rows(found[k]) for k in ("mean", "std", "min", "max", "trend")})
            if w in (60, 360):
                share = block_windows(y[1:], valid[1:], w, {"sum"}, at)
                out[f"util_{lbl}"] = rows(share["sum"][0] / share["n"][0])
                if w == 360:
                    out["high_share_6h"] = rows(share["sum"][1] / share["n"][1])
    for name, back in (("lag719", 720), ("lag59", 60), ("lag4", 5)):
        out[name] = last[end + MAXLEN - back]
    return out


def window_rows(belt: str, buffers: dict, events: pd.DataFrame, keep: list[str], th: Thresholds):
    """The rows of a belt's `events`, in the order in which they stand, as frames of bounded size: `keep` columns and
    the statistics of all sensors, from the event on at which every sensor has READY values.  Moves `buffers` on."""
    for start in range(0, len(events), PIECE):
        piece = events.iloc[start:start + PIECE]
        out = {c: piece[c].to_numpy() for c in keep}
        ready = np.ones(len(piece), dtype=bool)
        for s in STAT_SENSORS:
            own = (piece["sensorid"] == NAMES[s]).to_numpy()
            history, new = np.array(buffers[s], dtype=float), piece["avg_value"].to_numpy(dtype=float)[own]
            table, row = window_table(history, new, th.idle_current, th.high_load), np.cumsum(own)
            ready &= len(history) + row >= READY
            out.update({f"{s}_{f}": table[f][row] for f in STAT_FIELDS})
            buffers[s] = np.concatenate([history, new])[-MAXLEN:].tolist()
        rows = pd.DataFrame(out)[ready]
        rows.insert(0, "belt_id", belt)
        for lo in range(0, len(rows), FRAME):
            yield rows.iloc[lo:lo + FRAME]


def make_update(th: Thresholds):
    cols = [c.split()[0] for c in STATS_SCHEMA.split(", ")]

    def update(key, batches, state):
        held = dict(zip(STAT_SENSORS, state.get[:3], strict=True)) if state.exists else {s: [] for s in STAT_SENSORS}
        total = state.get[3] if state.exists else 0
        # a belt's events of one trigger; the source bounds what a trigger takes
        events = pd.concat(list(batches), ignore_index=True).sort_values("ingest_seq", kind="stable", ignore_index=True)
        for rows in window_rows(key[0], held, events, ["sensorid", "ingest_seq", "ts"], th):
            yield rows[cols]
        state.update((*[list(held[s]) for s in STAT_SENSORS], total + len(events)))

    return update


def stats_to_structs(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(*extra, "belt_id", "sensorid", "ingest_seq", "ts",
                     *[F.struct(*[F.col(f"{s}_{f}").alias(f) for f in STAT_FIELDS]).alias(s) for s in STAT_SENSORS])


def build_stream(events: DataFrame, th: Thresholds) -> DataFrame:
    """Streaming plan from raw payloads (`value`, `seq`) to alert records."""
    # predictions travel on a topic of their own and are no readings; within the
    # readings' topic (partition, offset) tells events apart
    if "topic" in events.columns:
        events = events.where(F.col("topic") == RAW_TOPIC).drop("topic")
    norm = normalize(events.withColumnRenamed("seq", "ingest_seq"))
    stats = (norm.select("belt_id", "sensorid", "ingest_seq", "ts", "avg_value")
                 .groupBy("belt_id")
                 .applyInPandasWithState(make_update(th), STATS_SCHEMA, STATE_SCHEMA, "append",
                                         GroupStateTimeout.NoTimeout))
    feats = stream_feature_columns(stats_to_structs(stats), th)
    return enrich(stream_safe_mode(feats, th), th)


def write_payload_files(readings: DataFrame, path: str) -> None:
    """Replay (SRC-8) of adapter readings as JSON lines with an arrival `seq`."""
    readings.select(F.to_json(F.struct(
        "belt_id", "sensorid", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("@timestamp"),
        "avg_value", F.col("ingest_seq").alias("seq"))).alias("value")).write.mode("overwrite").text(path)


@contextmanager
def few_state_partitions(spark: SparkSession):
    """A streaming query that starts in here has one state partition a core.  The engine's
    default deals the belts to hundreds, each of which every trigger opens, commits and reports."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), max(8, spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_stream_over_events(spark: SparkSession, sf: str, th: Thresholds | None = None, max_offsets: int = TRIGGER) -> DataFrame:
    """Replay the events table into a topic, run the streaming query over all of it,
    `max_offsets` payloads a trigger, and return the sink table."""
    from ..sources.readings import read_events_as_readings

    th = th or Thresholds()
    base = f"{checkpoint_dir(spark)}/stream-run/{os.path.basename(sf.rstrip('/'))}-{uuid.uuid4().hex}"
    belt = F.coalesce(F.col("belt_id"), F.lit(DEFAULT_BELT))        # the normaliser's belt: its payloads keep their order
    append_topic(replay_events(read_events_as_readings(spark, sf), belt.alias("key"), F.col("ingest_seq").alias("seq")), f"{base}/topics", RAW_TOPIC)
    arrived = read_topics(spark, f"{base}/topics", [RAW_TOPIC], f"{base}/progress", max_offsets)
    # the replayed payloads carry the arrival numbers of the table
    numbered = arrived.withColumn("seq", F.get_json_object("value", "$.seq").try_cast("long"))
    with few_state_partitions(spark):
        q = (build_stream(numbered, th).writeStream.format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/ckpt").outputMode("append").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.parquet(f"{base}/out")
