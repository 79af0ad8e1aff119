"""SNK-6: a store of model pairs in versions.

`<path>/v<number>` holds the health and the RUL pipeline, their settings (`meta`), the
importances and the metrics of the training as tables.  `_READY` is written last, so
a reader sees a whole version or none; the newest ready version is the current one.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession


class ModelUnreadable(Exception):
    """A version that is ready cannot be loaded."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def versions(spark: SparkSession, path: str, ready: bool = True) -> list[int]:
    """Numbers of the versions in a store, oldest first."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return []
    out = []
    for entry in fs.listStatus(root):
        found = re.fullmatch(r"v(\d+)", entry.getPath().getName())
        if found and (not ready or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_READY"))):
            out.append(int(found[1]))
    return sorted(out)


def _importances(spark: SparkSession, feats: list[str], health, rul) -> DataFrame | None:
    h, r = health.stages[-1], rul.stages[-1]
    if not (hasattr(h, "featureImportances") and hasattr(r, "featureImportances")):
        return None
    rows = zip(feats, h.featureImportances.toArray().tolist(), r.featureImportances.toArray().tolist(), strict=True)
    return spark.createDataFrame(list(rows), "feature string, health double, rul double")


def save(health, rul, path: str, feats: list[str], metrics: dict, target_transform: str = "log1p") -> int:
    """Stores a pair of pipelines as the next version and returns its number."""
    spark = SparkSession.getActiveSession()
    number = max(versions(spark, path, ready=False), default=0) + 1
    at = f"{path.rstrip('/')}/v{number}"
    health.write().overwrite().save(f"{at}/health")
    rul.write().overwrite().save(f"{at}/rul")
    table = _importances(spark, feats, health, rul)
    if table is not None:
        table.coalesce(1).write.mode("overwrite").parquet(f"{at}/importances")
    numbers = [(k, float(v)) for k, v in sorted(metrics.items()) if isinstance(v, (int, float))]
    spark.createDataFrame(numbers, "name string, value double").coalesce(1).write.mode("overwrite").parquet(f"{at}/metrics")
    meta = {"features": feats, "target_transform": target_transform, "version": number}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{at}/meta")
    fs, ready = _fs(spark, f"{at}/_READY")
    fs.create(ready, True).close()
    return number


def load(path: str, version: int | None = None):
    """(health, rul, meta) of a version (default: the current one); None where the store
    has none.  A version that is there but cannot be read raises ModelUnreadable."""
    from pyspark.ml import PipelineModel

    spark = SparkSession.getActiveSession()
    held = versions(spark, path)
    if not held or (version is not None and version not in held):
        return None
    at = f"{path.rstrip('/')}/v{held[-1] if version is None else version}"
    try:
        meta = json.loads(spark.read.json(f"{at}/meta").first()["meta"])
        return PipelineModel.load(f"{at}/health"), PipelineModel.load(f"{at}/rul"), meta
    except Exception as e:
        raise ModelUnreadable(f"{at}: {str(e).splitlines()[0][:200]}") from e
