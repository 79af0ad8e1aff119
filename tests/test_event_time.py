"""The stream's event-time mode: order within the delay, late events, silent belts, restarts."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearcast.config import CORE_SENSORS, Thresholds
from wearcast.sources.stream import RAW_TOPIC
from wearcast.sources.topics import append_topic, read_topics
from wearcast.streaming import job as J
from wearcast.streaming.event_time import HELD, LATE, EventTime, make_ordered_update

TH, MODE = Thresholds(), EventTime(delay_s=600)
START = pd.Timestamp("2025-03-01T00:00:00")


def made(n=360, belts=2):
    """(belt, sensor, minute, value): the sensors in turn, minute by minute."""
    rnd = random.Random(3)
    return [(f"belt-{b}", CORE_SENSORS[i % 3], i, rnd.uniform(40, 260)) for i in range(n) for b in range(belts)]


def shuffled(events, back):
    """The events in another order; none comes after one that is more than `back` minutes later."""
    rnd = random.Random(4)
    return sorted(events, key=lambda e: e[2] + rnd.uniform(0, back))


def payloads(spark, events):
    rows = [(b, i, f'{{"belt_id": "{b}", "sensorid": "{s}", "@timestamp": "{(START + pd.Timedelta(minutes=m)).isoformat()}Z", "avg_value": {v}}}')
            for i, (b, s, m, v) in enumerate(events)]
    return spark.createDataFrame(rows, "key string, seq long, value string")


def run(spark, base, event_time, max_offsets=150):
    events = read_topics(spark, f"{base}/topics", [RAW_TOPIC], f"{base}/progress", max_offsets)
    q = J.start(events, J.Routes(f"{base}/out", TH), f"{base}/ck", event_time)
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def emitted(spark, base):
    out = J.read_routed(spark, f"{base}/out", J.PREDICTIONS)
    return sorted(out.select("belt_id", "ts", "sensorid", F.round("ml_health", 6), "risk", F.round("degradation_index", 9)).collect())


def test_any_order_within_the_delay_gives_the_output_of_sorted_events(spark, tmp_path):
    events = made()
    last = max(m for *_, m, _ in events)
    flush = [(b, CORE_SENSORS[0], last + 60, 1.0) for b in ("belt-0", "belt-1")]
    a, b = str(tmp_path / "sorted"), str(tmp_path / "shuffled")
    append_topic(payloads(spark, events), f"{a}/topics", RAW_TOPIC)
    run(spark, a, None)
    mixed = shuffled(events, 9.9)
    assert mixed != events
    cut = len(mixed) // 2
    append_topic(payloads(spark, mixed[:cut]), f"{b}/topics", RAW_TOPIC)
    run(spark, b, MODE)                                     # a restart between the two halves
    append_topic(payloads(spark, mixed[cut:] + flush), f"{b}/topics", RAW_TOPIC)
    run(spark, b, MODE)
    want = emitted(spark, a)
    assert len(want) > 400 and emitted(spark, b) == want
    assert J.read_routed(spark, f"{b}/out", J.BAD).count() == 0


def test_late_events_go_to_the_bad_records(spark, tmp_path):
    base, events = str(tmp_path), made(200, 1)
    append_topic(payloads(spark, events), f"{base}/topics", RAW_TOPIC)
    run(spark, base, MODE, 1000)
    before = emitted(spark, base)
    late = [("belt-0", CORE_SENSORS[0], 20, 999.0), ("belt-0", CORE_SENSORS[1], 188, 50.0)]   # minute 189 is let through, so both are late
    append_topic(payloads(spark, late), f"{base}/topics", RAW_TOPIC)
    run(spark, base, MODE, 1000)
    bad = J.read_routed(spark, f"{base}/out", J.BAD).collect()
    assert sorted((r.reason, '"avg_value": 999.0' in r.value) for r in bad) == [(LATE, False), (LATE, True)]
    assert emitted(spark, base) == before and J.read_routed(spark, f"{base}/out", J.RAW).count() == 202


def test_the_timer_of_a_silent_belt(spark, tmp_path):
    base, events = str(tmp_path), made(120, 1)
    append_topic(payloads(spark, events), f"{base}/topics", RAW_TOPIC)
    q = J.start(read_topics(spark, f"{base}/topics", [RAW_TOPIC], f"{base}/progress", 1000), J.Routes(f"{base}/out", TH), f"{base}/ck", EventTime(600, 4))
    end = time.monotonic() + 60
    try:
        while time.monotonic() < end and (q.lastProgress is None or len(emitted(spark, base)) < 120 - 89):
            time.sleep(1)
    finally:
        q.stop()
    assert len(emitted(spark, base)) == 120 - 89


class State:
    """What the update function uses of a group's state."""
    exists, hasTimedOut, get, timeout = False, False, None, None

    def update(self, row):
        self.exists, self.get = True, row

    def setTimeoutDuration(self, ms):
        self.timeout = ms


@pytest.mark.parametrize("idle_s", [5, 3600])
def test_a_silent_belt_lets_everything_out(idle_s):
    update, state = make_ordered_update(TH, EventTime(600, idle_s)), State()
    events = pd.DataFrame([(s, i, m * 60_000_000, v, "p") for i, (_, s, m, v) in enumerate(made(120, 1))], columns=[*HELD, "value"])
    first = pd.concat(list(update(("b",), iter([events.sample(frac=1, random_state=1)]), state)))
    assert len(first) == 120 - 10 - 89 and state.timeout == idle_s * 1000 and len(state.get[5]) == 10
    state.hasTimedOut = True
    rest = pd.concat(list(update(("b",), iter([]), state)))
    assert rest["ingest_seq"].tolist() == list(range(110, 120)) and state.get[3] == 120 and state.get[5] == []
    state.hasTimedOut = False
    tie = events.tail(1).assign(ingest_seq=500)             # as old as the last one let through: not late
    older = events.tail(2).head(1).assign(ingest_seq=501)
    out = pd.concat(list(update(("b",), iter([pd.concat([tie, older])]), state)))
    assert out["ingest_seq"].tolist() == [501] and out["late"].tolist() == [True] and out["value"].tolist() == ["p"] and state.get[5] == [500]
