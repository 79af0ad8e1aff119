"""SRC-4: topics kept as folders of JSON lines, read as a stream with
(partition, offset) of every payload and a bound on what one trigger takes.

Layout: `<path>/<topic>/<partition>/<first offset>-<end offset>.jsonl`, one payload a
line, so listing the folders tells the newest offset of each partition.  Payloads of
one belt go to one partition, where the offset is the order of arrival; they need no
number of their own.

The engine's checkpoint holds the offsets.  It asks a Python source for the newest
offset without telling where it stands, so the source notes the end of each planned
trigger in `progress` (a folder beside the checkpoint) and goes at most `maxOffsets`
further from there; a replayed trigger is planned again by the engine from its own log.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.scan import sequence_index
from ..session import materialize

SEGMENT = re.compile(r"(\d{20})-(\d{20})\.jsonl$")
SEGMENT_ROWS = 100_000
SHIFT = 40        # bits of the offset in the arrival number


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def _segments(path: str, topic: str) -> dict[str, list[tuple[int, int, str]]]:
    """Segments (first, end, file) of each partition of a topic, by first offset."""
    store, root = _store(posixpath.join(path, topic))
    out: dict[str, list[tuple[int, int, str]]] = {}
    for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        found = SEGMENT.search(info.path)
        if found and info.is_file:
            part = posixpath.basename(posixpath.dirname(info.path))
            out.setdefault(part, []).append((int(found[1]), int(found[2]), info.path))
    return {p: sorted(s) for p, s in out.items()}


class Stretch(InputPartition):
    def __init__(self, topic: str, partition: int, file: str, first: int, start: int, end: int):
        self.topic, self.partition, self.file, self.first, self.start, self.end = topic, partition, file, first, start, end


class TopicReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.topics = options["path"], options["topics"].split(",")
        self.most, self.progress = int(options.get("maxoffsets", 200_000)), options["progress"]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        at, left = self._noted(), self.most
        behind = []
        for topic in self.topics:
            for part, held in _segments(self.path, topic).items():
                key = f"{topic}/{part}"
                at.setdefault(key, 0)
                behind.append((held[-1][1] - at[key], key))
        # the partitions share the bound; what one does not need goes to the others
        for i, (rows, key) in enumerate(sorted(behind)):
            take = min(max(rows, 0), max(1, left // (len(behind) - i)) if left else 0)
            at[key], left = at[key] + take, left - take
        return at

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self._note(end)
        out = []
        for topic in self.topics:
            for part, held in _segments(self.path, topic).items():
                lo, hi = start.get(f"{topic}/{part}", 0), end.get(f"{topic}/{part}", 0)
                out += [Stretch(topic, int(part), file, first, max(first, lo), min(last, hi)) for first, last, file in held if first < hi and last > lo]
        return out

    def read(self, stretch: Stretch) -> Iterator[tuple]:
        store, _ = _store(self.path)
        with store.open_input_stream(stretch.file) as held:
            rest, at = b"", stretch.first
            while at < stretch.end:
                block = held.read(1 << 20)
                lines = (rest + block).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if stretch.start <= at < stretch.end:
                        yield line.decode("utf-8", "replace"), stretch.topic, stretch.partition, at
                    at += 1
                if not block:
                    break

    def _noted(self) -> dict:
        store, root = _store(self.progress)
        if store.get_file_info(f"{root}/planned.json").type == fs.FileType.NotFound:
            return {}
        with store.open_input_stream(f"{root}/planned.json") as held:
            return json.loads(held.read())

    def _note(self, end: dict) -> None:
        store, root = _store(self.progress)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/planned.new") as out:
            out.write(json.dumps(end).encode())
        store.move(f"{root}/planned.new", f"{root}/planned.json")


class TopicFolders(DataSource):
    """Options: path, topics (comma-separated), progress, maxOffsets (a trigger)."""

    @classmethod
    def name(cls) -> str:
        return "topic_folders"

    def schema(self) -> str:
        return "value string, topic string, partition int, offset long"

    def streamReader(self, schema) -> TopicReader:
        return TopicReader({k.lower(): v for k, v in self.options.items()})


def read_topics(spark: SparkSession, path: str, topics: list[str], progress: str, max_offsets: int = 200_000) -> DataFrame:
    """value, topic and the arrival number `seq` of (partition, offset)."""
    spark.dataSource.register(TopicFolders)
    rows = (spark.readStream.format("topic_folders").option("topics", ",".join(topics)).option("progress", progress)
            .option("maxOffsets", max_offsets).load(path))
    return rows.select("value", "topic", (F.col("partition").cast("long") * F.lit(1 << SHIFT) + F.col("offset")).alias("seq"))


def append_topic(records: DataFrame, path: str, topic: str, order: str = "seq", partitions: int = 4, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Appends records(key, value, order) to a topic: a key's records go to one
    partition in their order.  Returns the segments written (partition, first, end).
    Only one such job may append to a topic at a time."""
    ends = {int(p): held[-1][1] for p, held in _segments(path, topic).items()}
    start = F.lit(0).cast("long")
    for p, end in ends.items():                                  # one entry a partition
        start = F.when(F.col("_part") == p, F.lit(end)).otherwise(start)
    part = F.pmod(F.xxhash64(F.coalesce(F.col("key"), F.lit(""))), F.lit(partitions)).cast("int")
    placed = records.select(part.alias("_part"), F.col(order).cast("long").alias("_order"), "value").withColumn("_chunk", F.floor(F.col("_order") / 65536))
    placed = materialize(placed, name="append")      # the ordinals read it three times; a payload is made once
    placed = sequence_index(placed, ["_part"], ["_order", "value"], "_chunk", "_at").select(
        "_part", "value", (F.col("_at") + start).alias("_at"), F.floor(F.col("_at") / rows).alias("_segment"))

    def write(key: tuple[Any, ...], held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("_at")
        first, end = int(held["_at"].iloc[0]), int(held["_at"].iloc[-1]) + 1
        store, root = _store(posixpath.join(path, topic, str(key[0])))
        store.create_dir(root, recursive=True)
        name = f"{root}/{first:020d}-{end:020d}.jsonl"
        with store.open_output_stream(f"{name}.new") as out:
            out.write("".join(str(v).replace("\n", " ") + "\n" for v in held["value"]).encode())
        store.move(f"{name}.new", name)                          # a segment is there whole or not at all
        return pd.DataFrame({"partition": [key[0]], "first": [first], "end": [end]})
    done = placed.groupBy("_part", "_segment").applyInPandas(write, "partition int, first long, end long")
    return records.sparkSession.createDataFrame(done.collect(), "partition int, first long, end long")   # one row a segment
