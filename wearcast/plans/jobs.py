"""The batch flow as one job: readings to cleaned rows, features, models, predictions,
summary, metrics and quality report (SRC-1..3,6,7, PRJ-1,4, AGG-4,5, ML-11,17,21,
SNK-1,4,5,6).

An unfit input raises behind the write of the cleaned rows, before anything is built.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MODEL_PARAMS, BeltMeta, Thresholds, belts_from, internal_feature_name
from ..operators import clean as C
from ..operators import grid as G
from ..session import materialize
from ..sources.readings import read_feature_table
from ..sources.sinks import read_by_day, write_by_day, write_report
from . import features as FE
from . import model_store
from . import score as S
from . import training as TR
from .model_scoring import score_table, unscored


def read_config(spark: SparkSession, path: str | None):
    """A JSON file read by Spark; None where there is no path or no file.  A file that is
    no JSON raises."""
    if not path:
        return None
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def thresholds_from(spark: SparkSession, path: str | None) -> Thresholds:
    """SRC-6: the thresholds of a file, or the defaults."""
    return Thresholds.from_dict(read_config(spark, path) or {})


def model_settings(spark: SparkSession, path: str | None) -> tuple[dict, list[str] | None, bool]:
    """SRC-6: (training parameters, features, whether a missing feature is an error) of a
    model config, or the shipped ones."""
    cfg = read_config(spark, path) or {}
    params = {k: type(v)(cfg.get(k, v)) for k, v in MODEL_PARAMS.items()}
    names = cfg.get("features")
    return params, [internal_feature_name(n) for n in names] if names else None, bool(cfg.get("fail_on_missing_features", True))


def belts_of(spark: SparkSession, path: str) -> list[BeltMeta]:
    """SRC-7: belt metadata of a file (one object or a list)."""
    raw = read_config(spark, path)
    if raw is None:
        raise ValueError(f"no belt metadata at {path}")
    return belts_from(raw)


def clean_to(readings: DataFrame, path: str, th: Thresholds) -> DataFrame:
    """Writes the cleaned rows; raises if none is a core reading, all are out of range, or
    a belt lacks a core sensor."""
    C.clean_readings(readings, th).write.mode("overwrite").parquet(path)
    cleaned = read_feature_table(readings.sparkSession, path)
    if cleaned.isEmpty():                                # only then the input is read again, to say why
        none = C.core_sensor_filter(readings).isEmpty()
        raise ValueError("no reading of a core sensor with a time and a value" if none else "all readings are out of range")
    C.assert_coverage(cleaned)
    return cleaned


def scored(feats: DataFrame, store: str | None, th: Thresholds, ml_only: bool = False) -> DataFrame:
    """ML-11, ML-17: rows scored with the current model of a store; one that cannot be
    read gives its status, a store without any safe mode."""
    try:
        models = model_store.load(store) if store else None
    except model_store.ModelUnreadable as e:
        return unscored(feats, "fallback_prediction_failed", str(e))
    return score_table(feats, models, th, ml_only)


def run_batch(readings: DataFrame, out: str, belts: list[BeltMeta], th: Thresholds | None = None, store: str | None = None,
              train: bool = False, params: dict | None = None, ml_only: bool = False, last_rows: int | None = None) -> DataFrame:
    """The whole flow into folders under `out`; returns the summary.  With `train` a model
    is fitted and stored first.  ML-21: the whole table is scored, or each belt's last
    `last_rows` rows.  Predictions carry the reference's column names."""
    th, spark = th or Thresholds(), readings.sparkSession
    cleaned = clean_to(readings, f"{out}/cleaned", th)
    means = materialize(G.minute_means(cleaned), spark, "means")
    write_by_day(FE.build_features(cleaned, spark, th, belts, means=means), f"{out}/features")
    feats = read_by_day(spark, f"{out}/features")
    write_report(S.quality_report(G.minute_grid(means), feats), f"{out}/quality", "belt_id")
    if train:
        write_report(TR.train_and_score(feats, spark, params, model_path=store), f"{out}/metrics", "name")
    rows = feats if last_rows is None else S.latest_n(feats, last_rows)
    write_by_day(FE.to_external(scored(rows, store, th, ml_only)), f"{out}/predictions")
    report = S.report(feats, th, lambda d: scored(d, store, th, ml_only))
    summary = materialize(S.summary(report, ml_only), spark, "summary")
    write_report(summary, f"{out}/summary", "belt_id")
    return summary
