"""Helpers shared by the operators: tables, shared scratch tables, Arrow batches."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_SLICE = 4 << 20  # bytes of text that one numpy step works on
ARROW_BYTES = 2 * TEXT_SLICE  # of an Arrow batch, where a step bounds it; a row is not cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.
    Only where it is unset (tests) a folder beside the warehouse is named."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoint")
    return sc.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables that one run writes into the shared folder; `drop` frees one that
    no later step reads.  Lost executors reread them, nothing is recomputed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        w = df.write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, most: int = ARROW_BYTES):
    """For jobs run inside: Arrow batches of about `most` bytes go to Python.  A
    batch is held some five times beside the heap and the worker (vectors, which
    grow by doubling, and the buffer for the socket), and Spark's default is 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = TEXT_SLICE) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that `column` holds about `most` bytes in each;
    a longer single value stays whole."""
    for batch in batches:
        at, held = 0, 0
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if len(sizes) > at:
            yield batch.slice(at)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str,
                column: str = "text", most: int = TEXT_SLICE, start: Callable | None = None) -> DataFrame:
    """mapInArrow over slices of bounded text; `start` builds what a task needs
    once (its value is fn's second argument)."""
    def run(batches):
        args = (start(),) if start else ()
        for part in slices(batches, column, most):
            out = fn(part, *args)
            if out is not None and out.num_rows:
                yield out
    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if v is None else v for v in batch.column(column).cast(pa.binary()).to_pylist()]


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema)


def utf8(df: DataFrame, column: str = "text") -> DataFrame:
    """doc_id and text only: extra columns of the input, whatever their names, are not touched."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("text"))
