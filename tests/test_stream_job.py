"""The streaming job: topic folders, model scoring, routed tables, restarts."""

import json

import pytest
from pyspark.sql import functions as F

from wearcast.config import CORE_SENSORS, Thresholds
from wearcast.plans import model_store
from wearcast.plans import queries as Q
from wearcast.plans import training as TR
from wearcast.plans.model_scoring import score_stream
from wearcast.session import materialize
from wearcast.sources.readings import read_events_as_readings, read_sensor_csv
from wearcast.sources.stream import RAW_TOPIC, kafka_records, read_events_stream, replay_events
from wearcast.sources.topics import append_topic, read_topics
from wearcast.streaming import batch_form as B
from wearcast.streaming import job as J
from wearcast.streaming.normalize import bad_records

from .conftest import SF_SMALL

TH = Thresholds()


@pytest.fixture(scope="module")
def rows(spark):
    return read_events_as_readings(spark, SF_SMALL).where("ingest_seq < 900").cache()


def payloads(rows):
    return replay_events(rows, "belt_id", "ingest_seq").withColumnsRenamed({"belt_id": "key", "ingest_seq": "seq"})


@pytest.fixture(scope="module")
def store(spark, rows, tmp_path_factory):
    """A store with forests of a few trees, fitted on stream features."""
    path = str(tmp_path_factory.mktemp("models"))
    f = B.features_of(rows, TH).withColumns({"target_health": F.lit(100.0) - 20 * F.col("degradation_index"), "target_rul_days": F.greatest(F.lit(0.0), 2000.0 - F.col("curr_avg")), "weight": F.lit(1.0)})
    f = materialize(f, spark)
    feats = ["curr_avg", "temp_avg", "elong_avg", "degradation_index", "elong_24h_mean", "warning_count"]
    pair = TR.fit_pair(f, feats, {"n_estimators": 3, "max_depth": 4, "min_samples_leaf": 1, "min_samples_split": 2, "random_state": 1})
    assert TR.save_models(*pair, path, feats, {"rows": 1.0, "note": "x"}) == 1
    return path


def run(spark, base, store=None, max_offsets=200_000, routes=J.Routes, fail=None):
    events = read_topics(spark, f"{base}/topics", [RAW_TOPIC], f"{base}/progress", max_offsets)
    q = J.start(events, routes(f"{base}/out", TH, store), f"{base}/ck")
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def emitted(spark, base, name=J.PREDICTIONS):
    return J.read_routed(spark, f"{base}/out", name)


def test_topic_offsets_and_bounds(spark, tmp_path):
    base = str(tmp_path)
    made = spark.range(5000).select(F.concat(F.lit("belt-"), F.col("id") % 5).alias("key"), F.col("id").alias("seq"), F.concat(F.lit("p"), F.col("id")).alias("value"))
    first = append_topic(made.where("seq < 3000"), f"{base}/topics", RAW_TOPIC, rows=400)
    assert first.agg(F.sum(F.col("end") - F.col("first"))).first()[0] == 3000
    sizes, seen = [], []

    def start():
        return (read_topics(spark, f"{base}/topics", [RAW_TOPIC], f"{base}/progress", 1000).writeStream.option("checkpointLocation", f"{base}/ck")
                .foreachBatch(lambda b, e: (seen.extend(b.collect()), sizes.append(b.count()))).start())
    q = start()
    q.processAllAvailable()
    q.stop()
    append_topic(made.where("seq >= 3000"), f"{base}/topics", RAW_TOPIC, rows=400)
    q = start()
    q.processAllAvailable()
    q.stop()
    assert max(sizes) <= 1000 and sum(sizes) == 5000 and sorted(r.value for r in seen) == sorted(f"p{i}" for i in range(5000))
    assert len({r.seq for r in seen}) == 5000
    order = [int(r.value[1:]) for r in sorted(seen, key=lambda r: r.seq)]
    for belt in range(5):
        mine = [i for i in order if i % 5 == belt]
        assert mine == sorted(mine)


def test_job_with_a_model_equals_the_batch_form(spark, rows, store, tmp_path):
    base = str(tmp_path)
    append_topic(payloads(rows), f"{base}/topics", RAW_TOPIC)
    run(spark, base, store, max_offsets=250)
    out = {(r.belt_id, r.ts, r.sensorid): r for r in emitted(spark, base).collect()}
    scored = score_stream(B.features_of(rows, TH), TR.load_models(store), TH)
    want = {(r.belt_id, r.ts, r.sensorid): r for r in B.enrich(scored, TH).collect()}
    assert set(out) == set(want) and len(out) > 100
    for k, r in out.items():
        e = want[k]
        for c in ("ml_health", "ml_rul_days", "failure_risk_score", "degradation_index"):
            assert abs(r[c] - e[c]) < 1e-6
        for c in ("risk", "health_band", "rul_band", "confidence_level", "prediction_status", "early_failure_flag"):
            assert r[c] == e[c]
    assert {r.prediction_status for r in out.values()} == {"ok"}
    assert len({r.ml_health for r in out.values()}) > 3
    led = emitted(spark, base, J.LEDGER).collect()
    assert len(led) >= 3 and sum(r.n_raw for r in led) == rows.count() and {r.model_version for r in led} == {1}


def test_lenient_projection_and_failed_rows(spark, store):
    models = TR.load_models(store)
    df = spark.createDataFrame([("b", 1, "7.5", 1.0, 0.2, float("nan")), ("b", 2, "x", None, 0.2, 1.0)],
                               "belt_id string, ingest_seq long, curr_avg string, temp_avg double, degradation_index double, elong_24h_mean double")
    bad, good = score_stream(df, models, TH).orderBy("ingest_seq").collect()
    assert (bad.prediction_status, bad.ml_health, bad.ml_rul_days, bad.confidence_level, bad.failure_risk_score) == ("failed", 0.0, 0.0, "LOW", 0.0)
    assert good.prediction_status == "ok" and good.curr_avg == "x" and good.temp_avg is None and good.ml_rul_days > 0


def test_kill_between_two_writes(spark, rows, tmp_path):
    """The job dies behind the raw table of its second epoch; the restart has every row once."""
    class Dies(J.Routes):
        def write(self, table, name, epoch):
            if epoch == 1 and name == J.PREDICTIONS:
                raise RuntimeError("killed")
            super().write(table, name, epoch)
    whole, cut = str(tmp_path / "whole"), str(tmp_path / "cut")
    for base in (whole, cut):
        append_topic(payloads(rows), f"{base}/topics", RAW_TOPIC)
    run(spark, whole, max_offsets=300)
    with pytest.raises(Exception, match="killed"):
        run(spark, cut, max_offsets=300, routes=Dies)
    assert emitted(spark, cut, J.RAW).count() == 300          # the unledgered epoch is not read
    run(spark, cut, max_offsets=300)
    for name in (J.RAW, J.PREDICTIONS):
        a, b = (sorted(map(str, emitted(spark, x, name).collect())) for x in (whole, cut))
        assert a == b and len(a) == len(set(a)) > 100


def test_newer_model_and_broken_model(spark, rows, store, tmp_path):
    base, models = str(tmp_path), str(tmp_path / "models")
    append_topic(payloads(rows.where("ingest_seq < 800")), f"{base}/topics", RAW_TOPIC)
    run(spark, base, models)
    h, r, meta = TR.load_models(store)
    TR.save_models(h, r, models, meta["features"], {})
    (tmp_path / "models" / "v2").mkdir()
    (tmp_path / "models" / "v2" / "_READY").touch()            # ready, but nothing in it
    (tmp_path / "models" / "v3" / "health").mkdir(parents=True)  # being written
    append_topic(payloads(rows.where("ingest_seq >= 800")), f"{base}/topics", RAW_TOPIC)
    run(spark, base, models)
    led = emitted(spark, base, J.LEDGER).collect()
    assert {(x.model_version, bool(x.model_error)) for x in led} == {(None, False), (1, True)}
    by = {x.prediction_status: x.n for x in emitted(spark, base).groupBy("prediction_status").agg(F.count("*").alias("n")).collect()}
    assert set(by) == {"safe_mode_calendar", "ok"}
    assert model_store.versions(spark, models) == [1, 2] and TR.load_models(str(tmp_path / "none")) is None
    with pytest.raises(model_store.ModelUnreadable):
        TR.load_models(models)
    imp = spark.read.parquet(f"{models}/v1/importances").collect()
    assert [x.feature for x in imp] == meta["features"] and abs(sum(x.health for x in imp) - 1) < 1e-6


def test_bad_payloads(spark, rows, tmp_path):
    base = str(tmp_path)
    good = payloads(rows)
    broken = spark.createDataFrame([("belt-1", 10_000 + i, v) for i, v in enumerate(
        ["no json", "[1]", '{"belt_id": "belt-1", "avg_value": "x"}', '{"avg_value": null}', "", '{"seq": "x", "avg_value": 1, "sensorid": "other"}'])], "key string, seq long, value string")
    append_topic(good.select("key", "seq", "value").unionByName(broken), f"{base}/topics", RAW_TOPIC)
    run(spark, base)
    assert sorted((r.value, r.reason) for r in emitted(spark, base, J.BAD).collect()) == [
        ("", "no JSON object"), ("[1]", "no JSON object"), ("no json", "no JSON object"),
        ('{"avg_value": null}', "a value is no number"), ('{"belt_id": "belt-1", "avg_value": "x"}', "a value is no number")]
    assert emitted(spark, base, J.RAW).count() == rows.count() + 6
    # the file form: an arrival number that is no number goes to the bad records, the stream goes on
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.jsonl").write_text('{"seq": "x", "avg_value": 1}\n{"seq": 5, "avg_value": 1}\n')
    q = J.start(read_events_stream(spark, f"{base}/files", max_files=1), J.Routes(f"{base}/files-out", TH), f"{base}/files-ck")
    q.processAllAvailable()
    q.stop()
    assert [r.reason for r in J.read_routed(spark, f"{base}/files-out", J.BAD).collect()] == ["no arrival number"]
    assert bad_records(broken).count() == 5


def test_csv_files_through_replay_and_job(spark, tmp_path):
    """Two CSV files: cleaned batch form and stream see one order of arrival."""
    for f in range(2):
        lines = ["belt_id,sensorid,@timestamp,avg_value"]
        for i in range(150):
            s = CORE_SENSORS[i % 3]
            lines.append(f"b1,{s},2026-01-01T{f:02d}:{i // 60:02d}:{i % 60:02d}Z,{(i * 37 + f * 11) % 100}")
        (tmp_path / f"in-{f}.csv").write_text("\n".join(lines) + "\n")
    r = read_sensor_csv(spark, f"{tmp_path}/in-*.csv")
    assert dict(r.dtypes)["ingest_seq"] == "bigint"
    assert [x.ts.minute * 60 + x.ts.second + 9000 * x.ts.hour for x in r.orderBy("ingest_seq").collect()] == [9000 * f + i for f in range(2) for i in range(150)]
    append_topic(payloads(r), f"{tmp_path}/topics", RAW_TOPIC)
    run(spark, str(tmp_path), max_offsets=100)
    out = sorted((x.ts, x.sensorid, round(x.degradation_index, 9)) for x in emitted(spark, str(tmp_path)).collect())
    want = sorted((x.ts, x.sensorid, round(x.degradation_index, 9)) for x in B.enrich(B.stream_safe_mode(B.features_of(r, TH), TH), TH).collect())
    assert out == want and len(out) > 200


def test_prediction_records(spark):
    df = spark.createDataFrame([(None, 1.5), ("b1", 2.5)], "belt_id string, ml_health double").withColumn("ts", F.to_timestamp(F.lit("2026-01-02 03:04:05")))
    out = {r.key: json.loads(r.value) for r in kafka_records(df).collect()}
    assert set(out) == {"GLOBAL", "b1"} and out["b1"] == {"belt_id": "b1", "ml_health": 2.5, "@timestamp": "2026-01-02T03:04:05.000000+00:00"}
