"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the text alone (sizes, character classes, repetition of
words and lines, word lengths).  The trees are grown level by level on binned
statistics with gradient histograms, fitted on a bounded sample of labelled
rows (SAMPLE, chosen by a hash of doc_id), and flattened into arrays: node i of
a tree has the children 2i+1 and 2i+2, so that numpy walks all rows of a batch
through all trees at once.

Null texts count as empty and get a score as any other; a null or unlabelled
doc_id is scored too.  Rows with null labels, and documents with labels of
both kinds, are left out of the fit.  Without labels of both kinds the score is
the share of label 1 (0.5 without any).  Repeated rows are scored each for
itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, texts, utf8

SAMPLE = 20_000   # labelled rows that a model is fitted on, about
TREES, DEPTH, RATE, BINS, L2 = 80, 4, 0.15, 64, 2.0
ACCEPT = 0.7      # a document of this score or more is kept

_CLASS = np.zeros((256, 7))
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-", b"!?", b"*#%&$@^~=+<>/\\_`{}[]", b"|", b" \t\n\r")):
    _CLASS[list(_chars), _i] = 1
N_FEATURES = 23


def statistics(text: bytes) -> list[float]:
    n = len(text)
    words = text.split()
    k = len(words)
    if not k:
        return [float(np.log1p(n))] + [0.0] * (N_FEATURES - 1)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    classes = (counts @ _CLASS) / n
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=k)
    often = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    top = often.most_common(1)[0][1]
    used = counts[counts > 0] / n
    tail = [w[-1] for w in words]
    return [float(np.log1p(n)), float(np.log1p(k)), *classes.tolist(),
            float(counts[128:].sum() / n), n / k, float(sizes.std()), float(sizes.max()), float((sizes > 14).mean()),
            len(often) / k, top / k, sum(map(eq, words, words[1:])) / k,
            len(set(lines)) / max(1, len(lines)), k / max(1, len(lines)),
            float(-(used * np.log2(used)).sum()), sum(w.isupper() for w in words) / k,
            sum(0x21 <= c <= 0x2F or c == 0x7C for c in tail) / k, (tail[-1] in b".!?") * 1.0]


@dataclass
class Trees:
    """Flattened trees; `bias` alone scores if there are none."""
    bias: float
    feature: np.ndarray     # (trees, 2^depth - 1), -1 where a node is not split
    threshold: np.ndarray   # go right if the statistic is above
    value: np.ndarray       # (trees, 2^depth) leaf values
    importance: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        n, trees = len(x), len(self.feature)
        raw = np.full(n, self.bias)
        if trees and n:
            depth = int(np.log2(self.value.shape[1]))
            node = np.zeros((n, trees), dtype=np.int64)
            at, rows = np.arange(trees)[None, :], np.arange(n)[:, None]
            for _ in range(depth):
                f = self.feature[at, node]
                node = 2 * node + 1 + ((f >= 0) & (x[rows, f] > self.threshold[at, node]))
            raw = raw + self.value[at, node - (2**depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE,
        bins: int = BINS, l2: float = L2, least: int = 20) -> Trees:
    """Boosting with logistic loss; splits maximise the gain of gradient histograms."""
    share = float(y.mean()) if len(y) else 0.5
    none = np.zeros((0, 2**depth - 1))
    if not len(y) or not 0 < share < 1:
        bias = 0.0 if share == 0.5 else 40.0 if share else -40.0
        return Trees(bias, none.astype(int), none, np.zeros((0, 2**depth)), np.zeros(x.shape[1]))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    model = Trees(float(np.log(share / (1 - share))), np.full((trees, 2**depth - 1), -1), np.zeros((trees, 2**depth - 1)),
                  np.zeros((trees, 2**depth)), np.zeros(x.shape[1]))
    raw = np.full(len(y), model.bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            width, base = 2**level, 2**level - 1
            best = np.full(width, 1e-6)
            split_f, split_b = np.full(width, -1), np.zeros(width, dtype=np.int64)
            for j, b in enumerate(binned):
                key, size = node * bins + b, width * bins
                hg, hh, hn = (np.bincount(key, weights=w, minlength=size).reshape(width, bins).cumsum(axis=1) for w in (g, h, np.ones(len(y))))
                G, H, N = hg[:, -1:], hh[:, -1:], hn[:, -1:]
                gain = hg**2 / (hh + l2) + (G - hg)**2 / (H - hh + l2) - G**2 / (H + l2)
                gain[(hn < least) | (N - hn < least)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better], split_f[better], split_b[better] = top[better], j, at[better]
            for i in np.flatnonzero(split_f >= 0):
                f = int(split_f[i])
                model.feature[t, base + i] = f
                model.threshold[t, base + i] = cuts[f][min(int(split_b[i]), len(cuts[f]) - 1)]
                model.importance[f] += best[i]
            f, b = split_f[node], split_b[node]
            node = 2 * node + ((f >= 0) & (binned[np.maximum(f, 0), np.arange(len(y))] > b))
        G, H = (np.bincount(node, weights=w, minlength=2**depth) for w in (g, h))
        model.value[t] = -rate * G / (H + l2)
        raw += model.value[t][node]
    return model


def held_out(doc_id):
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fits on about `sample` labelled rows outside the held-out part."""
    one = (labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
           .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
           .where("quality = other").select("doc_id", F.col("quality").cast("int").alias("quality")))
    total = one.count()
    if total > sample:      # by a hash of the id: a share of rows, the same in each run
        one = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int((1 << 32) * sample / total))
    # at most about `sample` rows of two numbers: small enough to broadcast by this bound
    rows = utf8(docs).join(F.broadcast(one), "doc_id").select("doc_id", "text", "quality")
    schema = "doc_id long, quality int, x array<double>"
    out = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("x", pa.list_(pa.float64()))])

    def step(batches):
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality").cast(pa.int32()),
                                              pa.array([statistics(t) for t in texts(part)], type=pa.list_(pa.float64()))], schema=out)

    got = rows.mapInArrow(step, schema).toArrow().combine_chunks()
    # one row per document, in an order that does not depend on the partitions
    order = np.unique(got.column("doc_id").to_numpy(), return_index=True)[1]
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES) if got.num_rows else np.zeros((0, N_FEATURES))
    return fit(x[order], got.column("quality").to_numpy()[order].astype(np.float64))


def with_score(docs: DataFrame, model: Trees, name: str) -> DataFrame:
    """docs with a column `name`: the score of `text`, 0 to 1."""
    schema = T.StructType([*(f for f in docs.schema if f.name != name), T.StructField(name, T.DoubleType())])
    kept = [c for c in docs.columns if c != name]

    def step(batches):
        for part in slices(batches, "text"):
            x = np.array([statistics(t) for t in texts(part)]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(x))], names=[*kept, name])

    return docs.select(*kept).mapInArrow(step, schema)


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    s = with_score(utf8(docs), model, "score")
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
