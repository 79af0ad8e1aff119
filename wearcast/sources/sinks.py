"""Table sinks: features by belt and day, predictions, summary and metrics (SNK-1, 4, 5, 7, TOP-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MINUTES = 24 * 60


def write_by_day(df: DataFrame, path: str, spread: int = 1) -> None:
    """Writes a minute table by belt and day, sorted by minute within each file.
    A day of a belt has at most 1,440 rows, so no partition grows; `spread`
    files per day are only needed for tables that hold more than one row a minute."""
    day = F.date_from_unix_date(F.floor(F.col("mi") / MINUTES).cast("int"))
    parts = df.withColumn("day", day)
    dealt = parts.repartition("belt_id", "day") if spread == 1 else \
        parts.withColumn("_s", F.pmod(F.xxhash64("mi"), F.lit(spread))).repartition("belt_id", "day", "_s").drop("_s")
    dealt.sortWithinPartitions("belt_id", "day", "mi").write.mode("overwrite").partitionBy("belt_id", "day").parquet(path)


def read_by_day(spark: SparkSession, path: str, last_days: int | None = None) -> DataFrame:
    """Reads such a table; with `last_days`, only the newest days' folders."""
    df = spark.read.option("basePath", path).parquet(path).withColumn("belt_id", F.col("belt_id").cast("string"))
    if last_days is not None:
        newest = df.agg(F.max("day")).first()[0]           # partition values only
        if newest is not None:
            df = df.where(F.col("day") > F.date_sub(F.lit(newest), last_days))
    return df.drop("day")


def cached_by_day(spark: SparkSession, path: str, build) -> DataFrame:
    """SNK-7: the stored table if there is one, else what build() gives, stored first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        write_by_day(build(), path)
    return read_by_day(spark, path)


def write_report(df: DataFrame, path: str, *order: str) -> None:
    """A small table (one row per belt or metric) as one sorted CSV file with a header."""
    df.coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)
