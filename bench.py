"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
  {"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

`feature_build` is the full batch feature job (clean -> minute grid ->
block-method windows -> condition/targets -> finalise) over the whole
events table; later queries reuse that materialised table the way the
reference reuses its cached feature file.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from wearcast.session import get_spark

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus))
    from wearcast.plans import queries as Q

    timings: dict[str, float] = {}

    def run(name, fn):
        t = time.time()
        df = fn()
        df.write.mode("overwrite").format("noop").save()
        timings[name] = round(time.time() - t, 3)

    def build():
        # minute bins + feature table, both kept for the later queries
        return Q.features(spark, sf_dir)

    run("feature_build", build)
    for name in ("minute_grid_interpolated", "safe_mode_score", "rolling_stats_24h", "quality_report",
                 "operational_risk", "flagship_report", "stream_features_batch_form", "stream_alerts"):
        run(name, lambda n=name: Q.QUERIES[n](spark, sf_dir))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
           "queries": timings, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
