"""Suffix-array dedup: removes every byte covered by a WINDOW-byte string that
also starts anywhere else, by a logarithmic family of sampled suffix indexes.

Suffixes are sampled at content-defined anchors (`anchors.py`): equal windows
have equal anchors, so no match of WINDOW bytes is lost.  An index level holds
the anchors' suffixes sorted by a 64-bit fingerprint of their first GRAM bytes
with the number of places where each stands; equal suffixes are neighbours, as
in a suffix array, which is all that matches of a fixed length need.

`SuffixIndex.add` puts a new batch in: its sorted suffixes are merge-scanned
with the levels (equal fingerprints are candidate matches) and, as in a binary
counter, levels of equal size merge with it into one twice the size, so every
entry is rewritten at most log2(batches) times.

Exact matches follow from the candidates.  A *run* is a stretch of windows that
share an anchor, named by a hash of all its bytes and the anchor's place in it.
 - A run that stands twice is repeated as a whole; counting suffices.
 - Runs of one anchor that differ (match ends) are compared window by window:
   one copy of each distinct run goes, with its bytes, to the other runs of its
   anchor.  Anchors with more than GROUP distinct runs are compared through a
   count by window instead, so that no anchor is gathered in one task.

Which anchors are candidates goes to the tasks as a bitmap of fixed size (it
may let others pass, which the exact counts then drop).

Null texts are empty and lose nothing.  Repeated rows are repeats of each other
(a text of WINDOW bytes or more that stands twice is removed in both rows);
rows are told apart by doc_id and text, so a null or repeated doc_id is no
matter.  Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import GRAM, WINDOW, Rolling, anchor_runs, mix
from .common import Scratch, record, slices, texts

BATCHES = 4
PIECE = 2 << 20     # bytes that one numpy step works on
BITS = 25           # log2 of the bits of a candidate bitmap
GROUP = 20_000      # distinct runs of one anchor that are compared in one task

ANCHOR = "doc_id long, thash long, gram long, run long, lo int, hi int, at int"


def prepared(docs: DataFrame) -> DataFrame:
    """(doc_id, thash, text): thash tells rows of equal doc_id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("thash"), text.alias("text"))


def _pieces(data: list[bytes]):
    """(row, first byte, bytes) in parts of about PIECE bytes; a longer text in
    parts that overlap by WINDOW - 1 bytes, so that each window is in one."""
    part, held = [], 0
    for row, d in enumerate(data):
        for at in range(0, max(1, len(d) - WINDOW + 1), PIECE):
            b = d[at:at + PIECE + WINDOW - 1]
            part.append((row, at, b))
            held += len(b)
            if held >= PIECE:
                yield part
                part, held = [], 0
    if part:
        yield part


def _anchors_of(data: list[bytes]):
    """(row, gram, run, lo, hi, at, bytes, first): anchors of a few texts; lo, hi are window starts in the text."""
    for part in _pieces(data):
        flat = np.frombuffer(b"".join(p[2] for p in part), dtype=np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(p[2]) for p in part])])
        doc, pos, lo, hi, gram, roll = anchor_runs(flat, starts)
        if not len(doc):
            continue
        run = mix(roll.span(lo, hi + WINDOW) + (pos - lo).astype(np.uint64))
        shift = np.array([p[1] for p in part]) - starts[:-1]
        rows = np.array([p[0] for p in part])
        yield rows[doc], gram.view(np.int64), run.view(np.int64), lo + shift[doc], hi + shift[doc], pos - lo, flat, lo


def _bit(x: np.ndarray, bits: int) -> np.ndarray:
    return x & ((1 << bits) - 1)


def _passes(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    b = _bit(keys, bits)
    return (bitmap[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1


def bitmap_of(keys: DataFrame, bits: int = BITS):
    """Bitmap with a bit for each of keys(key long), of 2^bits bits at any size of keys."""
    at = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.groupBy(F.shiftright(at, 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 31 as int))")).alias("v"))
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    got = words.toArrow()                         # at most 2^(bits - 5) rows of two numbers
    out[got.column("w").to_numpy()] = got.column("v").to_numpy().astype(np.uint32)
    return keys.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def _grams(docs: DataFrame) -> DataFrame:
    """(gram) of every anchor."""
    out = pa.schema([("gram", pa.int64())])

    def run(batches):
        for part in slices(batches, "text", PIECE):
            for _, gram, *_ in _anchors_of(texts(part)):
                yield record(out, gram)

    return docs.select("text").mapInArrow(run, "gram long")


class SuffixIndex:
    """Levels of sorted (gram, n); level k holds 2^k batches."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.levels, self.made = scratch, {}, 0

    def add(self, docs: DataFrame) -> None:
        """Puts a batch of prepared documents in; levels that come to equal size merge."""
        new, k, old = _grams(docs).select("gram", F.lit(1).cast("long").alias("n")), 0, []
        while k in self.levels:
            new, old = new.union(self.levels[k][1]), [*old, self.levels.pop(k)[0]]
            k += 1
        name = f"level-{self.made}"
        self.levels[k] = (name, self.scratch.save(new.groupBy("gram").agg(F.sum("n").alias("n")).sortWithinPartitions("gram"), name))
        self.made += 1
        self.scratch.drop(*old)

    def repeated(self) -> DataFrame:
        """(gram) of suffixes that stand at two places or more."""
        tables = [t for _, t in self.levels.values()]
        if len(tables) == 1:
            return tables[0].where("n > 1").select("gram")
        every = tables[0]
        for t in tables[1:]:
            every = every.union(t)
        return every.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")

    def matches(self, docs: DataFrame) -> DataFrame:
        """(gram) of suffixes of a new batch that some level holds: a merge-scan
        with each level, without putting the batch in."""
        new, found = _grams(docs).distinct(), None
        for _, t in self.levels.values():
            part = new.join(t, "gram", "left_semi")
            found = part if found is None else found.union(part)
        return new.limit(0) if found is None else found.distinct()


def _candidates(docs: DataFrame, bitmap, bits: int) -> DataFrame:
    out = pa.schema([("doc_id", pa.int64()), ("thash", pa.int64()), ("gram", pa.int64()), ("run", pa.int64()),
                     ("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int32())])

    def run(batches):
        bitmap_ = bitmap.value
        for part in slices(batches, "text", PIECE):
            for row, gram, run, lo, hi, at, *_ in _anchors_of(texts(part)):
                ok = np.flatnonzero(_passes(bitmap_, gram, bits))
                take = pa.array(row[ok])
                yield record(out, part.column("doc_id").take(take), part.column("thash").take(take), gram[ok], run[ok],
                             lo[ok].astype(np.int32), hi[ok].astype(np.int32), at[ok].astype(np.int32))

    return docs.mapInArrow(run, ANCHOR)


def _run_bytes(docs: DataFrame, bitmap, bits: int) -> DataFrame:
    """(gram, run, at, bytes) of runs that pass the bitmap, each once per step."""
    out = pa.schema([("gram", pa.int64()), ("run", pa.int64()), ("at", pa.int32()), ("bytes", pa.binary())])

    def run(batches):
        bitmap_ = bitmap.value
        for part in slices(batches, "text", PIECE):
            for _, gram, run, lo, hi, at, flat, first in _anchors_of(texts(part)):
                ok = np.flatnonzero(_passes(bitmap_, run, bits))
                ok = ok[np.unique(run[ok], return_index=True)[1]]
                raw, size = flat.tobytes(), hi - lo + WINDOW
                yield record(out, gram[ok], run[ok], at[ok].astype(np.int32),
                             [raw[a:a + n] for a, n in zip(first[ok].tolist(), size[ok].tolist(), strict=True)])

    return docs.mapInArrow(run, "gram long, run long, at int, bytes binary")


def _windows(batch) -> tuple[np.ndarray, ...]:
    """(row, place of the window in its run, distance to the anchor, hash) of all windows of the runs in a batch."""
    data = texts(batch, "bytes")
    size = np.array([len(d) for d in data], dtype=np.int64)
    starts = np.cumsum(size) - size
    n = size - WINDOW + 1
    row = np.repeat(np.arange(len(data)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    roll = Rolling(np.frombuffer(b"".join(data), dtype=np.uint8))
    begin = starts[row] + place
    at = batch.column("at").to_numpy()
    return row, place, at[row] - place, roll.span(begin, begin + WINDOW).view(np.int64)


def _ranges(row: np.ndarray, place: np.ndarray):
    """(row, first byte, end byte) of maximal ranges of windows at adjacent places."""
    cut = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(row)) - 1
    return row[first], place[first], place[last] + WINDOW


SPAN = "gram long, run long, a int, b int"


def _compare(runs: DataFrame) -> DataFrame:
    """Repeated ranges of runs that differ but share an anchor; the runs of an
    anchor stand together in a partition."""
    out = pa.schema([("gram", pa.int64()), ("run", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])

    def step(batch):
        if not batch.num_rows:
            return
        row, place, far, h = _windows(batch)
        gram, run = batch.column("gram").to_numpy(), batch.column("run").to_numpy()
        order = np.lexsort((h, far, gram[row]))
        key = (gram[row][order], far[order], h[order])
        same = np.logical_and.reduce([k[1:] == k[:-1] for k in key])
        twice = np.zeros(len(order), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = np.sort(order[twice])
        if len(hit):
            r, a, b = _ranges(row[hit], place[hit])
            yield record(out, gram[r], run[r], a.astype(np.int32), b.astype(np.int32))

    def run_all(batches):
        held = []                                     # rows of an anchor may go on in the next batch
        for batch in batches:
            for part in slices(iter([batch]), "bytes", PIECE):
                held.append(part)
                if sum(p.num_rows for p in held) < 2:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                gram = table.column("gram").to_numpy()
                end = int(np.searchsorted(gram, gram[-1]))
                if end:
                    yield from step(table.slice(0, end).combine_chunks().to_batches()[0])
                held = table.slice(end).to_batches()
        if held:
            yield from step(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return runs.repartition("gram").sortWithinPartitions("gram").mapInArrow(run_all, SPAN)


def _compare_by_window(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """The same for anchors with very many runs: windows are counted one by one."""
    out = pa.schema([(n, pa.int64()) for n in ("gram", "run", "place", "far", "h")])

    def run_all(batches):
        for part in slices(batches, "bytes", PIECE):
            row, place, far, h = _windows(part)
            yield record(out, part.column("gram").take(pa.array(row)), part.column("run").take(pa.array(row)), place, far.astype(np.int64), h)

    each = scratch.save(runs.mapInArrow(run_all, "gram long, run long, place long, far long, h long"), "windows")
    twice = each.groupBy("gram", "far", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hit = each.join(twice, ["gram", "far", "h"], "left_semi")
    # every window is a range of its own; they merge when a document's ranges do
    return hit.select("gram", "run", F.col("place").cast("int").alias("a"), (F.col("place") + WINDOW).cast("int").alias("b"))


def repeated_spans(docs: DataFrame, batches: int = BATCHES, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """(doc_id, thash, spans) of prepared documents with repeats; spans may overlap."""
    scratch = Scratch(docs.sparkSession, "suffix")
    index = SuffixIndex(scratch)
    for b in range(batches):
        index.add(docs.where(F.pmod(F.xxhash64("doc_id", "thash"), F.lit(batches)) == b))
    bitmap = bitmap_of(index.repeated().select(F.col("gram").alias("key")), bits)
    found = scratch.save(_candidates(docs, bitmap, bits), "candidates")
    scratch.drop(*(name for name, _ in index.levels.values()))

    counts = found.groupBy("gram", "run").agg(F.count(F.lit(1)).alias("n"))
    counts = scratch.save(counts, "runs")
    kinds = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    mixed = scratch.save(counts.join(kinds, "gram").select("gram", "run", "n", "kinds"), "mixed")
    ask = bitmap_of(mixed.select(F.col("run").alias("key")), bits)
    copies = _run_bytes(docs, ask, bits).groupBy("gram", "run").agg(F.first("at").alias("at"), F.first("bytes").alias("bytes"))
    copies = scratch.save(copies.join(mixed, ["gram", "run"]), "copies")
    partial = _compare(copies.where(F.col("kinds") <= group).select("gram", "run", "at", "bytes"))
    many = copies.where(F.col("kinds") > group)
    if not many.isEmpty():
        partial = partial.union(_compare_by_window(many.select("gram", "run", "at", "bytes"), scratch))
    whole = counts.where("n > 1").select("gram", "run", F.lit(0).alias("a"), F.lit(-1).alias("b"))
    once = partial.join(mixed.where("n = 1").select("gram", "run"), ["gram", "run"], "left_semi")
    spans = scratch.save(whole.union(once.select("gram", "run", "a", "b")), "spans")
    placed = found.join(spans, ["gram", "run"]).select(
        "doc_id", "thash", F.struct((F.col("lo") + F.col("a")).alias("start"),
                                    F.when(F.col("b") < 0, F.col("hi") + WINDOW).otherwise(F.col("lo") + F.col("b")).alias("end")).alias("span"))
    return placed.groupBy("doc_id", "thash").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, batches: int = BATCHES, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): maximal removed byte ranges (end exclusive)
    and the remaining bytes of every row of docs(doc_id, text)."""
    ready = prepared(docs)
    spans = repeated_spans(ready, batches, bits, group)
    same = ready["doc_id"].eqNullSafe(spans["doc_id"]) & (ready["thash"] == spans["thash"])
    both = ready.join(spans, same, "left").select(ready["doc_id"], "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    piece = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(piece)), ("kept", pa.binary())])

    def run(parts):
        for part in slices(parts, "text"):
            sizes, spans, kept = [], [], []
            for data, s, e in zip(texts(part), part.column("starts").to_pylist(), part.column("ends").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for a, b in sorted(zip(s or [], e or [], strict=True)):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                cuts = [0, *(x for m in merged for x in m), len(data)]
                sizes.append(len(data)), spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join(data[cuts[i]:cuts[i + 1]] for i in range(0, len(cuts), 2)))
            yield record(out, part.column("doc_id"), sizes, spans, kept)

    return both.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    """The contract's columns of `remove_repeats`."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                          F.sha2("kept", 256).alias("kept_sha256"))


__all__ = ["GRAM", "SuffixIndex", "WINDOW", "digest", "prepared", "remove_repeats", "repeated_spans"]
