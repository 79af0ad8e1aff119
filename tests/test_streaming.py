"""The stateful streaming query equals the batch form of the same events."""

from pyspark.sql import functions as F

from wearcast.plans import queries as Q
from wearcast.streaming import query as SQ

from .conftest import SF_SMALL


def test_stream_equals_batch_form(spark):
    stream = SQ.run_stream_over_events(spark, SF_SMALL)
    batch = Q.stream_alert_rows(spark, SF_SMALL)
    s = {(r.belt_id, r.ingest_seq): r for r in stream.collect()}
    b = {(r.belt_id, r.ingest_seq): r for r in batch.collect()}
    assert len(s) > 0 and set(s) == set(b)
    for k, r in s.items():
        e = b[k]
        assert (r.risk, r.health_band, r.rul_band) == (e.risk, e.health_band, e.rul_band)
        assert abs(r.ml_health - round(e.ml_health, 2)) < 0.011
        assert abs(r.degradation_index - e.degradation_index) < 1e-9


def test_ring_buffer_windows():
    import numpy as np

    from wearcast.config import Thresholds
    from wearcast.streaming.query import MAXLEN, window_table

    th = Thresholds()
    rng = np.random.default_rng(1)
    values = rng.normal(60, 20, 1600)
    for cut in (0, 1, 29, 1000, 1500):
        got = window_table(values[max(0, cut - MAXLEN):cut], values[cut:], th.idle_current, th.high_load)
        for i in (0, 1, 5, 60, len(values) - cut):
            buf = values[:cut + i][-MAXLEN:]
            if not 0 < len(buf) or i > len(values) - cut:
                continue
            for lbl, w in (("1h", 60), ("24h", 1440)):
                a = buf[-w:]
                assert np.isclose(got[f"w{lbl}_mean"][i], a.mean()) and np.isclose(got[f"w{lbl}_std"][i], a.std())
                assert (got[f"w{lbl}_min"][i], got[f"w{lbl}_max"][i]) == (a.min(), a.max())
                slope = np.polyfit(np.arange(len(a)), a, 1)[0] if len(a) > 1 else 0.0
                assert np.isclose(got[f"w{lbl}_trend"][i], slope)
            assert np.isclose(got["util_6h"][i], (buf[-360:] >= th.idle_current).mean())
            lag = got["lag719"][i]
            assert lag == buf[-720] if len(buf) >= 720 else np.isnan(lag)
            assert got["ord"][i] == len(buf) - 1 and got["v"][i] == buf[-1]


def test_several_triggers_and_a_restart(spark, tmp_path):
    """Two runs over one checkpoint, several files a run, equal one run over all."""
    from wearcast.config import Thresholds
    from wearcast.sources.readings import read_events_as_readings
    from wearcast.sources.stream import read_events_stream

    rows = read_events_as_readings(spark, SF_SMALL).where("ingest_seq < 900")
    cuts = [r[0] for r in rows.selectExpr("explode(percentile_approx(ingest_seq, array(0.3, 0.6)))").collect()]
    parts = [rows.where(F.col("ingest_seq") <= cuts[0]), rows.where((F.col("ingest_seq") > cuts[0]) & (F.col("ingest_seq") <= cuts[1])),
             rows.where(F.col("ingest_seq") > cuts[1])]

    def run(name, dfs):
        for i, df in enumerate(dfs):
            SQ.write_payload_files(df.coalesce(1), f"{tmp_path}/{name}/in/{i}")
            q = (SQ.build_stream(read_events_stream(spark, f"{tmp_path}/{name}/in/*"), Thresholds()).writeStream.format("parquet")
                 .option("path", f"{tmp_path}/{name}/out").option("checkpointLocation", f"{tmp_path}/{name}/ck")
                 .outputMode("append").trigger(availableNow=True).start())
            q.awaitTermination()
        return sorted(spark.read.parquet(f"{tmp_path}/{name}/out").select("belt_id", "sensorid", "ml_health", "risk", F.round("degradation_index", 9)).collect())

    whole, cut = run("whole", [rows]), run("cut", parts)
    assert len(whole) > 100 and whole == cut
