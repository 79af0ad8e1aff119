"""What a task of op10 holds at once does not grow with the blocks it writes and reads."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from wearcast.llm import decontam
from wearcast.llm.common import Scratch, arrow_batches

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_row_groups_of_the_index_are_bounded(spark):
    """One task and many blocks, the first of them small (from it Parquet would guess that
    all are), the others of text that compresses well or not at all."""
    rnd = random.Random(4)
    alike = " ".join(f"w{i}" for i in range(1000)) + " "
    other = " ".join(f"{rnd.getrandbits(32):x}" for i in range(500_000))                # no two texts fit one block
    docs = spark.createDataFrame([(0, "a few words", 1), *((i, alike, 900) for i in range(1, 9)), *((i, other, 1) for i in range(9, 17))], "doc_id long, t string, n int") \
        .selectExpr("doc_id", "repeat(t, n) text").repartition(1).sortWithinPartitions("doc_id")
    index = decontam.build_index(docs, Scratch(spark, "test_index"))
    assert index.count() >= 16
    groups = [m.row_group(i) for f in index.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == index.count() and max(g.num_rows for g in groups) <= 4
    assert max(g.total_byte_size for g in groups) < 32 << 20
    found = decontam.find_contamination(docs, spark.createDataFrame([(5, "W998 w999 w0")], "item_id long, text string"), index=index)
    assert {(r.doc_id, r.n_words, len(r.starts)) for r in found.collect()} == {(0, 3, 0), *((i, 900_000, 899) for i in range(1, 9)), *((i, 500_000, 0) for i in range(9, 17))}


def test_arrow_batches_are_bounded(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    big = spark.range(0, 40, 1, 1).selectExpr("id", "repeat('x', 1000000) t")
    spark.conf.unset(KEY)
    for before in (None, "50000000"):
        if before:
            spark.conf.set(KEY, before)
        with arrow_batches(spark, 4_000_000):
            n = [r.n for r in big.mapInArrow(sizes, "n long").collect()]
        assert sum(n) > 40_000_000 and max(n) < 6_000_000
        assert spark.conf.get(KEY, None) == before
    spark.conf.unset(KEY)


def test_found_rows_do_not_read_the_index_again(spark):
    docs = spark.createDataFrame([(1, "aa bb cc"), (2, "xx yy"), (None, None)], "doc_id long, text string")
    found = decontam.find_contamination(docs, spark.createDataFrame([(7, "aa bb")], "item_id long, text string"))
    assert spark.conf.get(KEY, None) is None
    assert not any("/index/" in f for f in found.inputFiles())
    assert {(r.doc_id, r.n_words, *r["items"]) for r in found.collect()} == {(1, 3, "7"), (2, 2), (None, 0)}


def test_windows_in_runs(monkeypatch):
    """Runs of a few windows and starts find what one run finds, and hold no more."""
    rnd = random.Random(3)
    word = lambda: rnd.choice(["aa", "bb", "cc", "dd", "ee"])
    texts = [[word() for _ in range(n)] for n in (80, 0, 3, 200, 1)]
    items = [(str(i), " ".join(word() for _ in range(rnd.randint(1, 12))).encode()) for i in range(60)]
    h = decontam.term_hashes([w.encode() for t in texts for w in t])
    positions = np.argsort(h, kind="stable").astype(np.int32)
    terms, firsts = np.unique(h[positions], return_index=True)
    doc_starts = np.cumsum([0, *map(len, texts)])
    tests = decontam.TestSet(items, 4)

    def found(slop):
        return sorted(zip(*(x.tolist() for x in tests.find(terms, np.append(firsts[1:], len(h)), positions, doc_starts, slop)), strict=True))

    whole, held, run = [found(s) for s in (0, 2)], [], decontam.TestSet._places

    def watched(self, live, order, count, *rest):
        held.append((len(live), int(count[self.terms[live, order[:, 0]]].sum())))
        return run(self, live, order, count, *rest)

    monkeypatch.setattr(decontam.TestSet, "_places", watched)
    monkeypatch.setattr(decontam, "WINDOWS", 7)
    monkeypatch.setattr(decontam, "STARTS", 100)
    assert whole[0] and len(whole[1]) > len(whole[0]) and [found(s) for s in (0, 2)] == whole
    assert len(held) > 10 and max(n for n, _ in held) <= 7 and max(n for _, n in held) < 100 + len(h)
