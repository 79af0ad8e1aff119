"""Growth of the streaming step and of the windows: bounded pieces, few tasks, one parse a payload."""

import numpy as np
import pandas as pd
import pytest

from wearcast.config import CORE_SENSORS, WINDOWS, Thresholds
from wearcast.operators.rolling import Spec, rolling_windows
from wearcast.plans.features import rolling_features
from wearcast.streaming import query as SQ

TH = Thresholds()


def test_a_belt_passes_in_bounded_pieces(monkeypatch):
    """the statistics of a belt's trigger are made piece by piece, and the pieces give the rows of the whole."""
    rng = np.random.default_rng(2)
    events = pd.DataFrame({"sensorid": [CORE_SENSORS[i % 3] for i in range(3000)], "ingest_seq": range(3000), "avg_value": rng.normal(60, 20, 3000)})
    whole_held, held = ({s: [] for s in SQ.STAT_SENSORS} for _ in range(2))
    whole = pd.concat(SQ.window_rows("b", whole_held, events, ["sensorid", "ingest_seq"], TH))
    sizes, plain = [], SQ.window_table
    monkeypatch.setattr(SQ, "window_table", lambda history, new, *a: sizes.append(len(new)) or plain(history, new, *a))
    monkeypatch.setattr(SQ, "PIECE", 700)
    monkeypatch.setattr(SQ, "FRAME", 100)
    frames = list(SQ.window_rows("b", held, events, ["sensorid", "ingest_seq"], TH))
    assert max(sizes) <= 700 and max(map(len, frames)) <= 100 and held == whole_held
    pd.testing.assert_frame_equal(pd.concat(frames).reset_index(drop=True), whole.reset_index(drop=True), rtol=1e-9)


def test_the_run_over_events_takes_bounded_triggers(spark):
    """several triggers, also with null belts, give the rows of one."""
    from .conftest import SF_SMALL
    cols = ["belt_id", "ingest_seq", "risk", "ml_health", "sensorid"]
    one, many = (sorted(map(tuple, SQ.run_stream_over_events(spark, SF_SMALL, max_offsets=n).select(*cols).collect())) for n in (500_000, 400))
    assert one == many and len(one) > 100


def test_the_stream_starts_with_few_state_partitions(spark):
    """what the tasks of a trigger report grows with their number."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        with SQ.few_state_partitions(spark):
            assert int(spark.conf.get("spark.sql.shuffle.partitions")) == max(8, spark.sparkContext.defaultParallelism)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_payload_is_parsed_once(spark):
    """neither the fields nor the filter on the reason parse the payload again."""
    from wearcast.streaming.normalize import normalize
    plan = normalize(spark.createDataFrame([("{}", 1)], "value string, ingest_seq long"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


@pytest.mark.parametrize("start", [0, -7])
def test_windows_of_a_constant_stretch_behind_a_step(spark, start):
    """whole-number columns keep their type, a constant window has no spread, rows without index get nulls."""
    rows = [("a", start + i, 0.1 if i < 40 else 1000.1, i % 2) for i in range(90)] + [("a", None, 5.0, 1)]
    df = spark.createDataFrame(rows, "belt_id string, mi long, x double, flag int")
    got = rolling_windows(df, ["belt_id"], "mi", {24: [Spec("x24", "x", ("n", "m2", "slope")), Spec("f24", "flag", ("n", "sum", "max"))]}, chunk_size=30)
    assert dict(got.dtypes)["f24_sum"] == "bigint" and dict(got.dtypes)["f24_max"] == "int"
    at = {r.mi: r for r in got.collect()}
    assert len(at) == 91 and at[None].x24_m2 is None and at[None].x24_n is None
    for i in range(64, 90):
        assert at[start + i].x24_m2 < 1e-18 and at[start + i].x24_slope == pytest.approx(0, abs=1e-12) and at[start + i].f24_sum == 12


def test_feature_windows_are_no_running_frames(spark):
    """Spark's windows only find the lags; the statistics come from one grouped step."""
    wide = spark.createDataFrame([("a", 0, 1.0, 2.0, 3.0)], "belt_id string, mi long, temp_avg double, elong_avg double, curr_avg double")
    plan = rolling_features(wide, TH)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and "var_pop" not in plan and len(WINDOWS) == 4
