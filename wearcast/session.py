"""Spark session defaults shared by tests, bench and the driver entry."""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # plans of some hundred columns: do not look up the Python line of every expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "wearcast", conf: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    for k, v in (conf or {}).items():
        b = b.config(k, v)
    if master:
        b = b.master(master)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("WEARCAST_DRIVER_MEMORY", "16g"))
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (`spark.checkpoint.dir`).

    In local mode, where it may be unset, a folder in the warehouse stands in; it
    is recorded in the session so every later call agrees.  On a cluster that
    folder could be any machine's own, so an unset setting raises.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not d:
        d = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoint"
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def materialize(df, spark: SparkSession | None = None, name: str = "t"):
    """Cut lineage at a fork point: write the table as Parquet into the
    shared checkpoint folder and read it back.  Survives executor loss
    (unlike localCheckpoint), and later readers prune columns and push
    filters into the scan, which a serialized RDD checkpoint cannot do."""
    import uuid

    spark = spark or df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
