import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wearcast.operators.rolling import Spec, rolling_windows
from wearcast.plans.features import rolling_features
from wearcast.config import Thresholds

STATS = ("n", "mean", "m2", "min", "max", "sum", "slope")


@pytest.mark.parametrize("start", [-20, 0, 17])
def test_windows_and_lags_across_chunks_equal_sliding_frames(spark, start):
    random.seed(start)
    rows = [(b, start + i, None if random.random() < 0.3 else random.uniform(-50, 50))
            for b, n in (("a", 70), ("b", 1), ("c", 31)) for i in range(n)]
    # a stretch without values that is longer than the smallest windows
    rows = [(b, i, None if b == "a" and 10 <= i < 25 else v) for b, i, v in rows]
    df = spark.createDataFrame(rows, "belt_id string, mi long, x double")
    sizes = (12, 6, 3)
    got = rolling_windows(df, ["belt_id"], "mi", {w: [Spec(f"w{w}", "x", STATS)] for w in sizes},
                          {"back5": ("x", 5), "back12": ("x", 12)}, chunk_size=14)
    order = Window.partitionBy("belt_id").orderBy("mi")
    want = df.withColumns({"back5": F.lag("x", 5).over(order), "back12": F.lag("x", 12).over(order)})
    for w in sizes:
        win = order.rowsBetween(-(w - 1), 0)
        n = F.count("x").over(win)
        want = want.withColumns({
            f"w{w}_n": n, f"w{w}_mean": F.avg("x").over(win), f"w{w}_m2": F.var_pop("x").over(win) * n,
            f"w{w}_min": F.min("x").over(win), f"w{w}_max": F.max("x").over(win), f"w{w}_sum": F.sum("x").over(win)})
    a = {(r.belt_id, r.mi): r.asDict() for r in got.collect()}
    b = {(r.belt_id, r.mi): r.asDict() for r in want.collect()}
    assert len(a) == len(rows) and a.keys() == b.keys()
    for k, row in b.items():
        for c, v in row.items():
            assert a[k][c] == (v if isinstance(v, (str, int, type(None))) else pytest.approx(v, abs=1e-7)), (k, c)


def test_sizes_must_divide_one_another(spark):
    df = spark.createDataFrame([("a", 0, 1.0)], "belt_id string, mi long, x double")
    with pytest.raises(ValueError, match="divide"):
        rolling_windows(df, ["belt_id"], "mi", {4: [Spec("w4", "x")], 6: [Spec("w6", "x")]})


def test_feature_windows_take_one_exchange_and_no_join(spark):
    wide = spark.createDataFrame([("a", 0, 1.0, 2.0, 3.0)], "belt_id string, mi long, temp_avg double, elong_avg double, curr_avg double")
    plan = rolling_features(wide, Thresholds())._jdf.queryExecution().executedPlan().toString()
    nodes = [line.strip(" +-:") for line in plan.splitlines()]
    assert sum("Exchange " in x for x in nodes) == 1 and not any("Join" in x for x in nodes)
    assert sum(x.startswith("Sort ") for x in nodes) == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "belt_id string, mi long, x double")
    assert rolling_windows(df, ["belt_id"], "mi", {6: [Spec("w", "x")]}, {"l": ("x", 2)}).count() == 0
