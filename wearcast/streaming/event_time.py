"""Event-time mode of the stream (STR-6): a reorder buffer per belt before the ring buffers.

Events may come out of order.  A belt's clock is the latest event time seen in it; an
event waits in the belt's state until the clock is `delay` past it, and then enters
the ring buffers in the order of (event time, arrival number).  So any order in which no event is
more than `delay` behind gives the output of the sorted events.  An event older than what
was already let through is late: it enters no buffer and goes to the bad records with
its payload.  An event exactly as old is not late.

The clock is the belt's own, so a belt that sends seldom loses nothing to one that
runs ahead.  With `idle_s`, a belt that is silent for so long by the wall clock lets everything
out (a processing-time timer); Spark then runs a batch at every trigger, with or without input, so the job sets
a trigger interval.  Without it the last events wait for the belt's next ones.  State holds the events of `delay`, besides the
at most 1,440 values per sensor.  Null event times do not occur: the normaliser puts the
time of arrival there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..config import Thresholds
from .batch_form import STAT_SENSORS
from .query import STATE_SCHEMA, STATS_SCHEMA, window_rows

LATE = "later than its belt's events by more than the delay"
HELD = {"sensorid": "string", "ingest_seq": "long", "us": "long", "avg_value": "double"}
OUT_SCHEMA = STATS_SCHEMA.replace("ts timestamp", "us long") + ", late boolean, value string"
ORDERED_STATE = STATE_SCHEMA + "".join(f", held_{c} array<{t}>" for c, t in HELD.items()) + ", clock long, passed long"


@dataclass(frozen=True)
class EventTime:
    delay_s: int = 600
    idle_s: int | None = None


def make_ordered_update(th: Thresholds, mode: EventTime):
    cols = [c.split()[0] for c in OUT_SCHEMA.split(", ")]
    none = np.iinfo(np.int64).min

    def update(key, batches, state):
        old = state.get if state.exists else None
        buffers, total = (dict(zip(STAT_SENSORS, old[:3], strict=True)), old[3]) if old else ({s: [] for s in STAT_SENSORS}, 0)
        waiting = pd.DataFrame(dict(zip(HELD, old[4:8], strict=True)) if old else {c: [] for c in HELD})
        clock, passed = old[8:] if old else (none, none)
        if state.hasTimedOut:
            ripe, waiting = waiting, waiting[:0]
        else:
            events = pd.concat(list(batches), ignore_index=True)
            late = events["us"] < passed
            if late.any():
                gone = events[late].reindex(columns=cols).astype({"late": object})
                gone["belt_id"], gone["late"] = key[0], True
                yield gone.astype(object).where(gone.notna(), None)
            clock = max(clock, int(events["us"].max()))
            fresh = events.loc[~late, list(HELD)]
            waiting = pd.concat([waiting, fresh], ignore_index=True) if len(waiting) else fresh
            out = waiting["us"] <= clock - mode.delay_s * 1_000_000
            ripe, waiting = waiting[out], waiting[~out]
        if len(ripe):
            ripe = ripe.sort_values(["us", "ingest_seq"], kind="stable", ignore_index=True).astype({"us": "int64", "ingest_seq": "int64"})
            passed, total = max(passed, int(ripe["us"].iloc[-1])), total + len(ripe)
            for rows in window_rows(key[0], buffers, ripe, ["sensorid", "ingest_seq", "us"], th):
                yield rows.assign(late=False, value=None)[cols]
        state.update((*[list(buffers[s]) for s in STAT_SENSORS], total, *[waiting[c].tolist() for c in HELD], clock, passed))
        if len(waiting) and mode.idle_s is not None:
            state.setTimeoutDuration(mode.idle_s * 1000)

    return update


def ordered_stats(readings: DataFrame, th: Thresholds, mode: EventTime) -> DataFrame:
    """STATS_SCHEMA with `late` and `value`: the statistics of every event of a ready belt in event-time
    order, and the late events, with no statistics but their payload.  `readings` holds the payload as `value`."""
    timed = readings.select("belt_id", "sensorid", "ingest_seq", F.unix_micros("ts").alias("us"), "avg_value", "value")
    timer = GroupStateTimeout.NoTimeout if mode.idle_s is None else GroupStateTimeout.ProcessingTimeTimeout
    out = timed.groupBy("belt_id").applyInPandasWithState(make_ordered_update(th, mode), OUT_SCHEMA, ORDERED_STATE, "append", timer)
    return out.withColumn("us", F.timestamp_micros("us")).withColumnRenamed("us", "ts")
