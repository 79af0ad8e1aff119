"""Gaps of the minute grid: days first, then minutes."""

import pytest
from pyspark.sql import functions as F

from wearcast.operators.grid import DAY, minute_grid


def means(spark, rows):
    return spark.createDataFrame([("b", "s", m, v, v, v, 0.5) for m, v in rows],
                                 "belt_id string, sensorid string, mi long, avg_value double, min_value double, max_value double, std_deviation double")


@pytest.mark.parametrize("step", [1, 7, 60, 4000])
def test_a_gap_over_days_is_filled_as_one_line(spark, step):
    marks = [(20_000_000 // step + k) * step for k in (0, 1, 5, 5 + 3 * DAY // step + 11)]
    rows = list(zip(marks, (1.0, 3.0, 7.0, -20.0), strict=True))
    got = {r.mi: r.avg_value for r in minute_grid(means(spark, rows), step=step).collect()}
    assert sorted(got) == list(range(marks[0], marks[-1] + 1, step))
    for (a, x), (b, y) in zip(rows, rows[1:], strict=False):
        assert all(got[t] == pytest.approx(x + (y - x) * (t - a) / (b - a)) for t in range(a, b, step))


def test_a_gap_of_years_is_dealt_out_by_days(spark):
    first, last = 0, 20 * 365 * DAY                       # 1970 and some 20 years later
    grid = minute_grid(means(spark, [(first, 0.0), (last, float(last))]), columns=("avg_value",), with_std=False)
    parts = grid.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("avg_value") - F.col("mi"))).alias("off")).collect()
    assert sum(r.n for r in parts) == last + 1 and max(r.off for r in parts) < 1e-6
    assert max(r.n for r in parts) < 2 * last / 8          # eight partitions
