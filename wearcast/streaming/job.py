"""The streaming job: payloads in; raw, prediction and bad-record tables out
(ML-16, SNK-2, SNK-3, STR-3..6, STR-8).

One query reads the readings' topic and writes three tables per trigger with
foreachBatch.  Each table has a folder per epoch, which a replayed epoch overwrites;
the ledger's row of an epoch is written last, and readers take ledgered epochs only.
So a kill between two writes leaves neither a double nor a lost row.

Each trigger scores with the newest ready model version of the store; a version that
cannot be read leaves the one before in use (without any: safe mode) and its error in
the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..config import Thresholds
from ..plans import model_store
from ..plans.model_scoring import score_stream
from ..sources.stream import RAW_TOPIC, kafka_records
from .batch_form import enrich, stream_feature_columns, stream_safe_mode
from .event_time import LATE, EventTime, ordered_stats
from .normalize import flagged, good_only
from .query import STATE_SCHEMA, STATS_SCHEMA, few_state_partitions, make_update, stats_to_structs

RAW, PREDICTIONS, BAD, LEDGER = "belt-raw-data", "belt-predictions", "belt-bad-records", "ledger"


def records(events: DataFrame, th: Thresholds, event_time: EventTime | None = None) -> DataFrame:
    """kind, belt_id, ingest_seq, value, reason, f: every payload as `raw`, those that are
    no readings also as `bad` with the reason, and the features of every event of a ready
    belt as `features`.  With `event_time` the events enter in the order of their times, and late ones are `bad` too."""
    mine = events.where(F.col("topic") == RAW_TOPIC).drop("topic") if "topic" in events.columns else events
    seen = flagged(mine.withColumnRenamed("seq", "ingest_seq"), keep_value=True)
    good, null = good_only(seen), F.lit(None).cast("string")
    if event_time is None:
        stats = (good.select("belt_id", "sensorid", "ingest_seq", "ts", "avg_value").groupBy("belt_id")
                 .applyInPandasWithState(make_update(th), STATS_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout))
        feats = stream_feature_columns(stats_to_structs(stats), th)
        packed = feats.select(F.lit("features").alias("kind"), "belt_id", "ingest_seq", null.alias("value"), null.alias("reason"),
                              F.struct(*feats.columns).alias("f"))
    else:
        feats = stream_feature_columns(stats_to_structs(ordered_stats(good, th, event_time), "late", "value"), th, keep=F.col("late"))
        late = F.col("late")
        packed = feats.select(F.when(late, "bad").otherwise("features").alias("kind"), "belt_id", "ingest_seq", "value",
                              F.when(late, LATE).alias("reason"),
                              F.when(~late, F.struct(*[c for c in feats.columns if c not in ("late", "value")])).alias("f"))
    none = F.lit(None).cast(packed.schema["f"].dataType).alias("f")
    kinds = F.when(F.col("reason").isNull(), F.array(F.lit("raw"))).otherwise(F.array(F.lit("raw"), F.lit("bad")))
    plain = seen.select(F.explode(kinds).alias("kind"), F.when(F.col("reason").isNull(), F.col("belt_id")).alias("belt_id"), "ingest_seq", "value",
                        "reason", none)
    return plain.unionByName(packed)


@dataclass
class Routes:
    """The foreachBatch function of the job."""
    base: str
    th: Thresholds
    store: str | None = None                 # model store
    kafka: dict | None = None                # options of a Kafka sink for predictions
    held: dict = field(default_factory=dict)  # the loaded version

    def model(self, spark: SparkSession) -> tuple[tuple | None, str]:
        """The model to score with, and the error of a newer one that cannot be read."""
        if self.store is None:
            return None, ""
        error = ""
        for number in reversed(model_store.versions(spark, self.store)):
            if number == self.held.get("number"):
                break
            try:
                self.held = {"number": number, "models": model_store.load(self.store, number)}
                break
            except model_store.ModelUnreadable as e:
                error = error or str(e)
        return self.held.get("models"), error

    def predictions(self, feats: DataFrame, models) -> DataFrame:
        scored = stream_safe_mode(feats, self.th) if models is None else score_stream(feats, models, self.th)
        return enrich(scored, self.th)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        spark = batch.sparkSession
        models, error = self.model(spark)
        kept = {RAW: batch.where("kind = 'raw'").select("belt_id", "ingest_seq", "value"),
                PREDICTIONS: self.predictions(batch.where("kind = 'features'").select("f.*"), models),
                BAD: batch.where("kind = 'bad'").select("ingest_seq", "value", "reason")}
        for name, table in kept.items():
            self.write(table, name, epoch)
        if self.kafka:
            kafka_records(kept[PREDICTIONS]).write.format("kafka").options(**self.kafka).save()
        counts = {r["kind"]: r["count"] for r in batch.groupBy("kind").count().collect()}
        row = (counts.get("raw", 0), counts.get("features", 0), counts.get("bad", 0), self.held.get("number"), error)
        self.write(spark.createDataFrame([row], "n_raw long, n_predictions long, n_bad long, model_version long, model_error string"), LEDGER, epoch)
        batch.unpersist()

    def write(self, table: DataFrame, name: str, epoch: int) -> None:
        table.write.mode("overwrite").parquet(f"{self.base}/{name}/epoch={epoch}")


def read_routed(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One of the job's tables: the rows of ledgered epochs."""
    done = spark.read.parquet(f"{base}/{LEDGER}").select("epoch").distinct()
    return spark.read.parquet(f"{base}/{name}").join(done, "epoch", "left_semi").drop("epoch")


def start(events: DataFrame, routes: Routes, checkpoint: str, event_time: EventTime | None = None):
    """Starts the job; `events` holds value, topic and seq."""
    writer = records(events, routes.th, event_time).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if event_time is not None and event_time.idle_s is not None:   # such a stream never rests
        writer = writer.trigger(processingTime=f"{max(1, event_time.idle_s // 10)} seconds")
    with few_state_partitions(events.sparkSession):
        return writer.foreachBatch(routes).start()
