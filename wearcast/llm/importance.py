"""Target-distribution importance resampling over hashed word features.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all other
characters above ASCII; features are all runs of 1 to `runs` consecutive words,
joined by one space.  A feature's bucket is the CRC-32 of its bytes modulo
`buckets`.  A bucket's gain is the log ratio of its smoothed shares in the target
and in the source; a document's weight is the sum of gains over its features, and
its score the weight plus a Gumbel draw from a hash of seed and doc_id, so that
the documents of highest score are a draw without replacement by weight.

CRC-32 is linear but for a constant that depends on the length alone: byte b with d
bytes behind it adds CONTRIBUTION[d, b].  The hashes of all features of a batch are
one lookup a byte and one bitwise_xor.reduceat over the features' spans, with LENGTH
as the constants.  A span of more than BLOCK bytes is cut into blocks from its end;
their sums are folded from the first block on, each step moving the register past
BLOCK bytes by four lookups.

Two passes read the texts: bucket counts, added up per task before the shuffle (at
most `buckets` numbers a task), and weights.  Places are numbers within ranges of
the sorted scores plus the sizes of earlier ranges (one number a range); equal
scores, a hot doc_id or repeated rows may span ranges.

Null texts have no words, weight 0 and are not drawn; a null doc_id counts as the
empty string in the draw and comes last among equal scores; repeated rows take part
each for itself.  An empty source gives an empty result; an empty target gives
gains against the uniform distribution.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, record, slices, texts, utf8

BLOCK = 64               # bytes whose contributions are tabulated
STEP = 1 << 20           # bytes that one lookup handles
POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, reversed
MASK = np.uint32(0xFFFFFFFF)


def _zeros(register: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
    """Registers after n zero bytes more."""
    for _ in range(n):
        register = (register >> np.uint32(8)) ^ table[register & np.uint32(0xFF)]
    return register


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & np.uint32(1), (one >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), one >> np.uint32(1)).astype(np.uint32)
    by_distance = [one]
    for _ in range(BLOCK - 1):
        by_distance.append(_zeros(by_distance[-1], one, 1))
    start = [np.array([MASK])]
    for _ in range(BLOCK):
        start.append(_zeros(start[-1], one, 1))
    move = np.stack([_zeros(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), one, BLOCK) for k in range(4)])
    return np.concatenate(by_distance), np.concatenate(start), move


CONTRIBUTION, LENGTH, MOVE = _tables()    # [256 * distance + byte], register by length, four bytes of a register


def _spread(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in all spans, their distances from the end of theirs, and where each span begins."""
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    return np.repeat(starts, lengths) + within, np.repeat(lengths, lengths) - 1 - within, first


def linear(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XOR of the contributions of the bytes of each span (1 to BLOCK bytes)."""
    out, ends = np.empty(len(starts), dtype=np.uint32), np.cumsum(lengths)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, "right")))
        at, distance, first = _spread(starts[lo:hi], lengths[lo:hi])
        out[lo:hi] = np.bitwise_xor.reduceat(CONTRIBUTION[256 * distance + data[at]], first)
        lo = hi
    return out


def crc32_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:start + length] for each span of one byte or more."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint32)
    long_ = lengths > BLOCK
    out = np.empty(len(starts), dtype=np.uint32)
    out[~long_] = linear(data, starts[~long_], lengths[~long_]) ^ LENGTH[lengths[~long_]]
    if long_.any():
        s, n = starts[long_], lengths[long_]
        blocks = -(-n // BLOCK)
        head = n - (blocks - 1) * BLOCK
        base = np.cumsum(blocks) - blocks
        size = np.full(int(blocks.sum()), BLOCK)
        size[base] = head
        k = np.arange(len(size)) - np.repeat(base, blocks)
        begin = np.repeat(s, blocks) + np.where(k > 0, np.repeat(head, blocks) + (k - 1) * BLOCK, 0)
        sums = linear(data, begin, size)
        register = sums[base] ^ LENGTH[head]
        live = np.arange(len(s))
        for step in range(1, int(blocks.max())):
            live = live[blocks[live] > step]
            r = register[live]
            moved = MOVE[0][r & np.uint32(255)] ^ MOVE[1][(r >> np.uint32(8)) & np.uint32(255)] \
                ^ MOVE[2][(r >> np.uint32(16)) & np.uint32(255)] ^ MOVE[3][r >> np.uint32(24)]
            register[live] = moved ^ sums[base[live] + step]
        out[long_] = register
    return out ^ MASK


def _wordy() -> np.ndarray:
    b = np.arange(256)
    return ((b >= 0x30) & (b <= 0x39)) | ((b >= 0x61) & (b <= 0x7A)) | (b >= 0x80)


WORDY = _wordy()


def features(values: list[bytes], runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC-32 of each feature, its text's number, words of each text)."""
    data = np.frombuffer(b"\x00" + b"\x00".join(values) + b"\x00", dtype=np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    edge = np.diff(WORDY[data].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    first = np.cumsum([1] + [len(v) + 1 for v in values])
    doc = np.searchsorted(first, starts, "right") - 1
    words = np.bincount(doc, minlength=len(values))[:len(values)]
    if runs == 1:
        return crc32_spans(data, starts, ends - starts), doc, words
    at, _, begin = _spread(starts, ends - starts + 1)         # each word and one byte behind it
    data = data[at]
    lengths = ends - starts
    data[begin + lengths] = 0x20
    crc, owner = [], []
    for k in range(1, runs + 1):
        i = np.arange(max(0, len(starts) - k + 1))
        i = i[doc[i] == doc[i + k - 1]]
        crc.append(crc32_spans(data, begin[i], begin[i + k - 1] + lengths[i + k - 1] - begin[i]))
        owner.append(doc[i])
    return np.concatenate(crc), np.concatenate(owner), words


COUNTS = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])


def bucket_counts(texts_: DataFrame, buckets: int, runs: int) -> np.ndarray:
    """Features of all texts by bucket; `buckets` numbers reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]):
        held = np.zeros(buckets, dtype=np.int64)
        for part in slices(batches, "text"):
            crc, _, _ = features(texts(part), runs)
            held += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(held)
        if len(some):
            yield record(COUNTS, some, held[some])
    rows = texts_.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long") \
        .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the shares smoothed by one, in thousandths, rounded down."""
    more = len(source)
    all_s, all_t = float(source.sum() + more), float(target.sum() + more)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def gumbel(seed: int, doc_id: int | None) -> int:
    """A Gumbel draw in thousandths, rounded down, from a hash of seed and doc_id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])


def scored(docs: DataFrame, gain: np.ndarray, runs: int, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of docs(doc_id, text)."""
    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        crc, owner, words = features(texts(batch), runs)
        n = np.bincount(owner, minlength=batch.num_rows)
        weight = np.zeros(batch.num_rows, dtype=np.int64)
        np.add.at(weight, owner, gain[crc % np.uint32(len(gain))])
        ids = batch.column("doc_id").to_pylist()
        score = weight + np.array([gumbel(seed, d) for d in ids], dtype=np.int64)
        return record(SCORED, pa.array(ids, pa.int64()), words.astype(np.int64), n.astype(np.int64), weight, score)
    return map_batches(utf8(docs), some, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000,
             runs: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs; rank
    is 1, 2, ... for the floor(percent * N / 100) highest scores (ties: smaller doc_id)
    among the N documents of `least_words` words or more, else null."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "importance")
    gain = gains(bucket_counts(docs, buckets, runs), bucket_counts(target, buckets, runs))
    rows = scored(docs, gain, runs, seed).withColumns({"_fit": F.col("n_words") >= least_words, "_row": F.monotonically_increasing_id()})
    rows = scratch.save(rows, "scored")
    order = [F.col("_fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row").asc()]
    # number within the range: the partition in the upper bits, the place in the lower 33
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.save(placed, "ordered")
    ranges = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_fit").cast("long")).alias("fit")).collect()
    before, offsets = 0, []
    for r in sorted(ranges, key=lambda r: r["_part"]):       # one row a range
        offsets.append((r["_part"], before))
        before += r.n
    draw = percent * sum(r.fit for r in ranges) // 100
    shift = spark.createDataFrame(offsets, "_part long, _before long")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(shift), "_part").select(
        "doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= draw, rank).alias("rank"))


def digest(drawn: DataFrame) -> DataFrame:
    """The contract's columns of the result of `resample`."""
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
