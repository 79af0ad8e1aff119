"""Periodic runs in the words of a text, found by block convolution.

Words are the stretches between ASCII white space, numbered from 0.  A run is a
maximal stretch of words with smallest period q (words q apart are equal) that is
at least MIN_WORDS and MIN_PERIODS * q words long.

Scale B = 1, 2, 4, ... finds the periods q with B <= q < 2B.  The words are cut into
blocks of B.  A run of four periods or more covers a whole block within its first B
words, and the block's copy q words on.  The sum of squared differences between a
block and every stretch of B words that begins B to 2B - 1 words on is an integer
convolution, taken exactly modulo a prime by number-theoretic transforms of size 2B
over all blocks at once; it is zero where the block occurs again.  Each such
distance seeds an extension to both sides, which is the run if it is long enough.

Two exact tests spare transforms; neither loses a run:
* every pair of neighbouring words in the 2B words from a run's first block on comes
  again q words on, so a block is left out if one of these pairs does not recur
  within 2B - 1 words;
* a seed whose block and copy lie in a run of a smaller scale is left out: two runs
  of different smallest periods p < q share fewer than p + q words.

Extensions use prefix hashes (two primes) and a binary search, all seeds at once;
the runs that result are compared word by word.  The texts of an Arrow batch are one
sequence with a separator of its own behind each text, so no run crosses texts.

Null texts are empty; texts without words have no runs.  Repeated rows are handled
each for itself, null doc_id included; other columns are not read; an empty table
gives an empty result.  Texts are never cut: memory is some 100 bytes a word of the
longest text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, record, texts, utf8

MIN_WORDS, MIN_PERIODS = 6, 4
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])

# fixed values: a prime 15 * 2^27 + 1 with a generator of its units, and bases and primes of the hashes
PRIME, GENERATOR = 2013265921, 31
HASHES = ((2147483647, 1103515245), (2147483629, 69069069))
CELLS = 1 << 18          # numbers that one step of transforms holds
FAR = np.int64(1 << 40)


def _roots(half: int, inverse: bool, known: dict) -> np.ndarray:
    """Powers 0 .. half - 1 of a root of unity of order 2 * half."""
    if (half, inverse) not in known:
        root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
        known[half, inverse] = powers(pow(root, -1, PRIME) if inverse else root, half, PRIME)
    return known[half, inverse]


def powers(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.int64)
    k = 1
    while k < n:
        out[k:2 * k] = out[:min(k, n - k)] * pow(base, k, prime) % prime
        k *= 2
    return out[:n]


def _forward(a: np.ndarray, known: dict) -> np.ndarray:
    """Transform of each row; the order of the result is bit-reversed."""
    rows, n = a.shape
    half = n // 2
    while half:
        v = a.reshape(rows, -1, 2, half)
        low, high = v[:, :, 0], v[:, :, 1]
        both = np.empty_like(v)
        both[:, :, 0] = (low + high) % PRIME
        both[:, :, 1] = (low - high) % PRIME * _roots(half, False, known) % PRIME
        a, half = both.reshape(rows, n), half // 2
    return a


def _backward(a: np.ndarray, known: dict) -> np.ndarray:
    """Inverse of `_forward`."""
    rows, n = a.shape
    half = 1
    while half < n:
        v = a.reshape(rows, -1, 2, half)
        low, high = v[:, :, 0], v[:, :, 1] * _roots(half, True, known) % PRIME
        both = np.empty_like(v)
        both[:, :, 0] = (low + high) % PRIME
        both[:, :, 1] = (low - high) % PRIME
        a, half = both.reshape(rows, n), half * 2
    return a * pow(n, -1, PRIME) % PRIME


def occurrences(x: np.ndarray, at: np.ndarray, size: int, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index into `at`, distance) of each zero-mismatch occurrence of the block of
    `size` numbers at x[at] that begins size to 2 * size - 1 places on.  x holds numbers
    below PRIME, with 3 * size more of them behind the last block."""
    known = {} if known is None else known
    rows = np.arange(len(at))
    found = []
    for lo in range(0, len(at), max(1, CELLS // (2 * size))):
        part = rows[lo:lo + max(1, CELLS // (2 * size))]
        block = x[at[part, None] + np.arange(size)]
        after = x[at[part, None] + size + np.arange(2 * size - 1)]
        a = np.zeros((len(part), 2 * size), dtype=np.int64)
        b = np.zeros_like(a)
        a[:, :size] = block[:, ::-1]
        b[:, :2 * size - 1] = after
        cross = _backward(_forward(a, known) * _forward(b, known) % PRIME, known)[:, size - 1:2 * size - 1]
        sums = np.concatenate([np.zeros((len(part), 1), dtype=np.int64), np.cumsum(after * after % PRIME, axis=1)], axis=1)
        squares = (block * block % PRIME).sum(axis=1)[:, None] + sums[:, size:] - sums[:, :size]
        i, d = np.nonzero((squares - 2 * cross) % PRIME == 0)
        found.append((part[i], d + size))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (rows[:0], rows[:0])


class Prefix:
    """Hashes of all prefixes, for the longest equal stretches at two places."""

    def __init__(self, w: np.ndarray):
        self.n, self.held = len(w), []
        for prime, base in HASHES:
            up = powers(base, len(w) + 1, prime)
            term = (w + 1) % prime * up[:-1] % prime
            # sums of 2^31-bounded terms stay exact in 63 bits for 2^32 words
            self.held.append((prime, up, np.concatenate([[0], np.cumsum(term) % prime])))

    def equal(self, i: np.ndarray, d: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether w[i:i + n] and w[i + d:i + d + n] are equal."""
        out = np.ones(len(i), dtype=bool)
        for prime, up, h in self.held:
            out &= (h[i + n] - h[i]) % prime * up[d] % prime == (h[i + d + n] - h[i + d]) % prime
        return out

    def extend(self, i: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[start, end) of the longest stretch of period d around i."""
        return i - self._most(i, d, i, back=True), i + d + self._most(i, d, self.n - i - d, back=False)

    def _most(self, i, d, most, back):
        low, high = np.zeros_like(i), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            fits = self.equal(i - mid if back else i, d, mid)
            low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
        return low


def _exact(w: np.ndarray, s: int, e: int, d: int, i: int) -> tuple[int, int]:
    """The stretch (s, e) if it has period d and ends where the period does, else
    (a clash of hashes) the stretch around i by comparison."""
    if (w[s:e - d] == w[s + d:e]).all() and (s == 0 or w[s - 1] != w[s - 1 + d]) and (e == len(w) or w[e] != w[e - d]):
        return s, e
    s, e = i, i + d
    while s > 0 and w[s - 1] == w[s - 1 + d]:
        s -= 1
    while e < len(w) and w[e] == w[e - d]:
        e += 1
    return s, e


def runs_of(w: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of the numbers w, by start and period;
    `longest` bounds the length of a stretch (longest text)."""
    n, none = len(w), np.zeros((0, 3), dtype=np.int64)
    if longest < MIN_WORDS:
        return none
    w = w.astype(np.int64)
    pair = w[:-1] * (int(w.max()) + 1) + w[1:]
    order = np.argsort(pair, kind="stable")
    again = np.full(n, FAR)
    same = pair[order[1:]] == pair[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    x, prefix, known = None, None, {}
    found, size, level = [], 1, again            # level: largest distance in each block
    reach = np.zeros(n, dtype=np.int64)          # furthest end of a run found so far that starts at or before
    while size <= longest // MIN_PERIODS:
        later = np.append(level[1:], FAR)
        at = np.flatnonzero(np.maximum(level, later) < 2 * size) * size
        at = at[reach[at] < at + 3 * size - 1]
        if len(at):
            if x is None:
                x = np.concatenate([w * 1000003 % (PRIME - 1) + 1, np.zeros(3 * longest + 4, dtype=np.int64)])
                prefix = Prefix(w)
            k, d = occurrences(x, at, size, known)
            i = at[k]
            open_ = (i + d + size <= n) & (reach[i] < i + d + size)
            i, d = i[open_], d[open_]
            s, e = prefix.extend(i, d)
            long_ = e - s >= np.maximum(MIN_WORDS, MIN_PERIODS * d)
            rows = np.unique(np.stack([s, e, d, i], axis=1)[long_], axis=0)
            rows = rows[np.append(True, (np.diff(rows[:, :3], axis=0) != 0).any(axis=1))] if len(rows) else rows
            new = [(a, b, p) for a, b, p in ((*_exact(w, *map(int, r)), int(r[2])) for r in rows) if b - a >= max(MIN_WORDS, MIN_PERIODS * p)]
            if new:
                found += new
                ends = np.zeros(n, dtype=np.int64)
                np.maximum.at(ends, [a for a, _, _ in new], [b for _, b, _ in new])
                reach = np.maximum(reach, np.maximum.accumulate(ends))
        size *= 2
        level = np.append(level, FAR) if len(level) % 2 else level
        level = np.maximum(level[0::2], level[1::2])
    if not found:
        return none
    # a stretch that was found with a multiple of its period was found with the period too
    rows = np.array(sorted(set(found)), dtype=np.int64)
    rows = rows[np.append(True, (np.diff(rows[:, :2], axis=0) != 0).any(axis=1))]
    rows = np.stack([rows[:, 0], rows[:, 1] - rows[:, 0], rows[:, 2]], axis=1)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def find_runs(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """For each row of docs(doc_id, text): n_words, its runs by start and period, and
    the collapsed text: the words that are in no run behind its first period, joined by
    one space.  `edit` may change the words of a text first."""
    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("doc_id").to_pylist()
        split = [t.split() for t in texts(batch)]
        if edit is not None:
            split = [edit(d, w) for d, w in zip(ids, split, strict=True)]
        counts = np.array([len(w) for w in split], dtype=np.int64)
        first = np.cumsum(counts + 1) - counts - 1           # a separator follows each text
        flat = numbered([x for w in split for x in w])
        seq = np.empty(len(flat) + len(split), dtype=np.int64)
        own = np.ones(len(seq), dtype=bool)
        own[first + counts] = False
        seq[own] = flat
        seq[~own] = (int(flat.max()) + 1 if len(flat) else 0) + np.arange(len(split))
        runs = runs_of(seq, int(counts.max()))
        cut = np.searchsorted(runs[:, 0], np.append(first, len(seq)))
        out, kept = [], []
        for k, words in enumerate(split):
            mine = runs[cut[k]:cut[k + 1]] - [first[k], 0, 0]
            out.append([{"start": a, "length": b, "period": c} for a, b, c in mine.tolist()])
            if len(mine):
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, mine[:, 0] + mine[:, 2], 1)
                np.add.at(edge, mine[:, 0] + mine[:, 1], -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            kept.append(b" ".join(words))
        return record(OUT, pa.array(ids, pa.int64()), pa.array(counts), pa.array(out, OUT.field("runs").type), pa.array(kept, pa.binary()).view(pa.string()))
    return map_batches(utf8(docs), some, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the result of `find_runs`: the run of greatest
    exact length / period (first by start, then period, among equals) and hashes."""
    first = F.element_at("runs", 1)
    best = F.aggregate("runs", first, lambda held, r: F.when(r["length"] * held["period"] > held["length"] * r["period"], r).otherwise(held))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"),
                        sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                       F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
