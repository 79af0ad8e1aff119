"""Benchmark decontamination: distributed positional inverted index.

`build_index` turns the training texts into blocks.  A block is one row and
stands for some MB of whole documents: its words are numbered through, and
for each term (64-bit hash of the word) it holds the ascending positions at
which the term stands.  Blocks are independent, so the index needs no shuffle
and grows and recovers block by block; it is written once to the shared
folder and serves any number of test sets.  A task holds a few blocks at a time,
however many it writes or reads: the numbers of a block are packed as bytes (a list
column costs its reader two more numbers an element), and row groups are closed at
BLOCKS rows or ROW_GROUP bytes, looked at after each row (Parquet looks after 100 by
default, then as many later as the rows so far let it guess, and one small block makes
that guess wrong; Spark reads a row group of up to 4,096 rows at once).  Arrow batches hold ARROW_BYTES
while the index is written and searched; what is found is written, so that no later
step reads the index in larger ones.

`search` looks for every window of the test set in every block: per block the
terms of a window are ordered by their number of postings, the list of the
rarest gives the starts, and these are intersected with the offset-adjusted
lists of the other terms.  slop = 0 finds exact phrases; slop = s finds windows
whose terms each stand at most s words from their place beside the rarest, in
the same document; the hit range is the window beside the rarest, cut to it.
Windows are taken in runs of bounded numbers of windows and starts.

The test set is read in parts of at most QUERY_BYTES (each part is checked
against the bound before it goes to the executors); all parts meet all blocks.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
Null or empty texts have no words and no hits; items without words have no
windows; an item of fewer words than a window is one window.  Repeated items
count once per item_id, repeated rows of documents each for themselves.  Other
columns are not read; empty tables give empty results (no items: no hits).
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, map_batches, record, texts, utf8

WINDOW = 10
QUERY_BYTES = 4 << 20
ROW_GROUP = 16 << 20   # bytes of a row group of the index, compressed
BLOCKS = 4             # rows of it at most, however well they compress
WINDOWS = 1 << 16      # windows that are looked up at once
STARTS = 1 << 20       # places that are compared at once; a window's places stay together
_WORD = bytes(b if (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80) else 0x20 for b in range(256))

# packed: doc_starts, term_ends and positions are 32-bit, terms 64-bit little-endian integers
INDEX = "block long, doc_ids array<long>, doc_starts binary, terms binary, term_ends binary, positions binary"
PACKED = {"doc_starts": "<i4", "terms": "<i8", "term_ends": "<i4", "positions": "<i4"}
FOUND = "block long, row int, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(_WORD).split()


def term_hashes(flat: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, flat), dtype=np.uint64, count=len(flat)).view(np.int64)


def build_index(docs: DataFrame, scratch: Scratch, name: str = "index") -> DataFrame:
    out = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((name, pa.binary()) for name in PACKED)])

    def packed(values, name):
        return pa.array([np.asarray(values, dtype=PACKED[name]).tobytes()], type=pa.binary())

    def numbers():
        # unique over the table, which is written once: 2^30 blocks for each task
        return itertools.count(TaskContext.get().partitionId() << 30)

    def step(batch, numbers):
        found = [term_hashes(words(t)) for t in texts(batch)]     # the words of one text at a time
        h = np.concatenate(found)
        order = np.argsort(h, kind="stable").astype(np.int32)
        h = h[order]
        ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h)) if len(h) else np.zeros(0, dtype=np.int64)
        ids = batch.column("doc_id")
        return record(out, [next(numbers)], pa.ListArray.from_arrays(pa.array([0, len(ids)], type=pa.int32()), ids),
                      packed(np.cumsum([0, *map(len, found)]), "doc_starts"), packed(h[ends - 1], "terms"),
                      packed(ends, "term_ends"), packed(order, "positions"))

    made = map_batches(utf8(docs), step, INDEX, start=numbers)
    with arrow_batches(docs.sparkSession):
        made.write.option("compression", "zstd").option("parquet.enable.dictionary", "false") \
            .option("parquet.block.size", ROW_GROUP).option("parquet.block.row.count.limit", BLOCKS) \
            .option("parquet.page.size.row.check.min", 1).option("parquet.page.size.row.check.max", 1).parquet(scratch.path(name))
    return docs.sparkSession.read.schema(INDEX).parquet(scratch.path(name))


class TestSet:
    """Distinct windows of some test items, over their sorted vocabulary."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        by_window: dict[tuple, set[str]] = {}
        for item, text in items:
            h = term_hashes(words(text)).tolist()
            if h:
                for i in range(max(1, len(h) - window + 1)):
                    by_window.setdefault(tuple(h[i:i + window]), set()).add(item)
        self.names = sorted({x for s in by_window.values() for x in s})
        place = {x: i for i, x in enumerate(self.names)}
        rows = list(by_window)
        self.items = [np.array(sorted(place[x] for x in by_window[r]), dtype=np.int64) for r in rows]
        self.sizes = np.array([len(r) for r in rows], dtype=np.int64)
        flat = np.array([t for r in rows for t in r], dtype=np.int64)
        self.vocabulary, at = np.unique(flat, return_inverse=True)
        self.terms = np.full((len(rows), window), -1, dtype=np.int64)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.terms[np.repeat(np.arange(len(rows)), self.sizes), col] = at

    def find(self, terms, ends, positions, doc_starts, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, start, document) of all places in one block, each within one document;
        with slop, a start may lie before the document."""
        none = np.zeros(0, dtype=np.int64)
        if not len(self.vocabulary) or not len(terms):
            return none, none, none
        at = np.minimum(np.searchsorted(terms, self.vocabulary), len(terms) - 1)
        there = terms[at] == self.vocabulary
        begin = np.where(there, np.where(at > 0, ends[at - 1], 0), 0).astype(np.int64)
        count = np.where(there, ends[at].astype(np.int64) - begin, 0)
        # sorted (term, position) of the vocabulary's lists, for all windows at once
        off = np.cumsum(count) - count
        total = np.repeat(begin - off, count) + np.arange(count.sum())
        listed = positions[total].astype(np.int64) + (np.repeat(np.arange(len(count)), count) << 32)
        found = [(none, none, none)]
        for low in range(0, len(self.terms), WINDOWS):
            rows = self.terms[low:low + WINDOWS]
            n = np.where(rows >= 0, count[rows], np.iinfo(np.int64).max)
            least = n.min(axis=1)
            live = np.flatnonzero(least > 0)
            order = np.argsort(n[live], axis=1, kind="stable")       # rarest first
            run = (np.cumsum(least[live]) - 1) // STARTS
            for part in np.split(np.arange(len(live)), np.flatnonzero(run[1:] != run[:-1]) + 1):
                if len(part):
                    found.append(self._places(live[part] + low, order[part], count, off, listed, doc_starts, slop))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _places(self, live, order, count, off, listed, doc_starts, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What `find` returns, of the windows `live`."""
        first = order[:, 0]
        t = self.terms[live, first]
        win = np.repeat(live, count[t])
        slot = np.repeat(np.arange(len(live)), count[t])
        inner = np.arange(len(win)) - np.repeat(np.cumsum(count[t]) - count[t], count[t])
        rarest = listed[off[self.terms[win, first[slot]]] + inner] & 0xFFFFFFFF
        start = rarest - first[slot]
        doc = np.searchsorted(doc_starts, rarest, side="right") - 1
        for k in range(1, self.terms.shape[1]):
            low, high = doc_starts[doc].astype(np.int64), doc_starts[doc + 1].astype(np.int64)
            if not slop:                                             # no term can be displaced into the document
                ok = (start >= low) & (start + self.sizes[win] <= high)
                win, slot, start, doc, low, high = win[ok], slot[ok], start[ok], doc[ok], low[ok], high[ok]
            col = order[slot, k]
            term = self.terms[win, col]
            least = (term << 32) + np.maximum(start + col - slop, low)
            most = (term << 32) + np.minimum(start + col + slop, high - 1)
            at = np.minimum(np.searchsorted(listed, np.where(term >= 0, least, 0)), len(listed) - 1)
            ok = (term < 0) | ((least <= most) & (listed[at] >= least) & (listed[at] <= most))
            win, slot, start, doc = win[ok], slot[ok], start[ok], doc[ok]
        return win, start, doc


def search(index: DataFrame, tests: TestSet, slop: int = 0, all_rows: bool = True) -> DataFrame:
    """For each document (with all_rows, else only those that are hit) its hit
    word ranges and the items found in it."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(tests)      # bounded by QUERY_BYTES of text
    out = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
                     ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])

    def run(batches):
        test = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name: np.frombuffer(batch.column(name)[i].as_buffer(), dtype=PACKED[name])  # noqa: E731, B023
                doc_starts = get("doc_starts")
                ids = batch.column("doc_ids")[i].values
                win, start, doc = test.find(get("terms"), get("term_ends"), get("positions"), doc_starts, slop)
                end = np.minimum(start + test.sizes[win], doc_starts[doc + 1])
                start = np.maximum(start, doc_starts[doc])
                by_doc: dict[int, tuple[list, list, set]] = {}
                order = np.lexsort((end, start, doc))
                for d, w, a, b in zip(doc[order].tolist(), win[order].tolist(), start[order].tolist(), end[order].tolist(), strict=True):
                    a, b = a - int(doc_starts[d]), b - int(doc_starts[d])
                    starts, ends, items = by_doc.setdefault(d, ([], [], set()))
                    items.update(test.items[w].tolist())
                    if ends and a <= ends[-1]:
                        ends[-1] = max(ends[-1], b)
                    else:
                        starts.append(a), ends.append(b)
                rows = range(len(ids)) if all_rows else sorted(by_doc)
                if not len(rows):
                    continue
                none = ([], [], ())
                yield record(out, pa.array([batch.column("block")[i].as_py()] * len(rows), type=pa.int64()), list(rows),
                             ids.take(pa.array(rows, type=pa.int32())), [int(doc_starts[r + 1] - doc_starts[r]) for r in rows],
                             [by_doc.get(r, none)[0] for r in rows], [by_doc.get(r, none)[1] for r in rows],
                             [sorted(test.names[x] for x in by_doc.get(r, none)[2]) for r in rows])

    return index.mapInArrow(run, FOUND)


def test_sets(items: DataFrame, window: int, query_bytes: int):
    """The test set in parts of bounded size."""
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")) \
                 .where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(2 * size / query_bytes))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        yield TestSet([(r.item, r.text.encode()) for r in rows.toLocalIterator()], window)


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0,
                       query_bytes: int = QUERY_BYTES, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, starts, ends, items) of every row of docs: maximal hit
    word ranges (end exclusive) and the items that have a window in the text."""
    scratch = Scratch(docs.sparkSession, "decontam")
    index = build_index(docs, scratch) if index is None else index
    found = None
    several = False
    for tests in test_sets(items, window, query_bytes):
        part = search(index, tests, slop, all_rows=found is None)
        several = found is not None
        found = part if found is None else found.union(part)
    if several:                                  # ranges of several parts may meet: merged in each row
        spans = F.arrays_zip("starts", "ends")
        found = found.groupBy("block", "row").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list(spans))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        merged = F.expr("""aggregate(spans, cast(array() as array<struct<starts:int,ends:int>>), (acc, s) ->
            if(size(acc) > 0 and s.starts <= acc[size(acc) - 1].ends,
               concat(slice(acc, 1, size(acc) - 1), array(named_struct('starts', acc[size(acc) - 1].starts,
                      'ends', greatest(acc[size(acc) - 1].ends, s.ends)))),
               concat(acc, array(s))))""")
        found = found.withColumn("spans", merged).select(
            "doc_id", "n_words", F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"), "items")
    with arrow_batches(docs.sparkSession):
        return scratch.save(found.select("doc_id", "n_words", "starts", "ends", "items"), "found")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of `find_contamination`."""
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                     ("items_sha256", pa.string()), ("contaminated", pa.bool_())])

    def run(batches):
        for b in batches:
            hit = [sum(e) - sum(s) for s, e in zip(b.column("starts").to_pylist(), b.column("ends").to_pylist(), strict=True)]
            items = b.column("items").to_pylist()
            yield record(out, b.column("doc_id"), b.column("n_words"), hit, [len(x) for x in items],
                         [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], [n > 0 for n in hit])

    return found.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
