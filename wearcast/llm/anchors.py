"""Content-defined anchors over UTF-8 bytes (numpy), shared by the suffix index.

A *window* is WINDOW consecutive bytes of one document.  Every window holds
WINDOW - GRAM + 1 grams of GRAM bytes; its anchor is the gram with the least
hash (leftmost on ties).  The anchor depends on the window's bytes alone, so
two equal windows have their anchors at equal offsets: comparing only suffixes
that start at anchors loses no match of WINDOW bytes or more, and there are
about 2 anchors in 170 bytes instead of one suffix per byte.
"""

from __future__ import annotations

import numpy as np

WINDOW = 200
GRAM = 32
_ODD = 0x9E3779B97F4A7C15  # odd multiplier of the rolling polynomial (mod 2^64)


def powers(n: int, base: int = _ODD) -> np.ndarray:
    p = np.full(n + 1, base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads the polynomial over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of substrings of `data` in O(1) each: prefix sums of
    byte * base^i mod 2^64, divided by base^start (base is odd, so it has an
    inverse) and mixed.  They do not depend on what stands around the substring."""

    def __init__(self, data: np.ndarray, base: int = _ODD):
        n = len(data)
        pw = powers(n, base)
        self.inverse = powers(n, pow(base, -1, 1 << 64))
        self.pre = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[:n], out=self.pre[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.pre[end] - self.pre[start]) * self.inverse[start]
        return mix(h ^ mix((end - start).astype(np.uint64)))

    def every(self, width: int) -> np.ndarray:
        """Hash of data[i:i+width] for every i."""
        m = len(self.pre) - width
        h = (self.pre[width:] - self.pre[:m]) * self.inverse[:m]
        return mix(h)


def anchor_runs(data: np.ndarray, starts: np.ndarray, gram: int = GRAM, window: int = WINDOW):
    """Anchors of all windows of the documents laid end to end in `data`.

    starts: first byte of each document, then len(data).  Returns arrays
    (doc, pos, lo, hi, gram_hash, rolling): windows that begin at bytes
    lo..hi of `data` (inclusive) have the gram at `pos` as their anchor.
    """
    empty = np.zeros(0, dtype=np.int64)
    if len(data) < window:
        return empty, empty, empty, empty, empty.astype(np.uint64), None
    roll = Rolling(data)
    g = roll.every(gram)
    w = window - gram + 1
    m = len(data) - window + 1                      # windows, some across documents
    # sliding minimum over w grams: block-wise prefix and suffix minima
    pad = -len(g) % w
    gp = np.concatenate([g, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    pre = np.minimum.accumulate(gp, axis=1).ravel()
    suf = np.minimum.accumulate(gp[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(suf[:m], pre[w - 1:w - 1 + m])
    # stretches of windows with the same least gram, and its leftmost place
    lo = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    hi = np.append(lo[1:], m) - 1
    pos = _leftmost(g, least, lo, w)
    lo_all, hi_all, pos_all = [], [], []
    # equal grams inside one stretch: when the leftmost one leaves the window
    # the next equal gram takes over, so cut the stretch there
    over = hi > pos
    while over.any():
        keep_lo, keep_hi, keep_pos = lo[~over], hi[~over], pos[~over]
        lo_all.append(keep_lo), hi_all.append(keep_hi), pos_all.append(keep_pos)
        lo, hi, pos = lo[over], hi[over], pos[over]
        lo_all.append(lo), hi_all.append(pos.copy()), pos_all.append(pos)
        lo = pos + 1
        pos = _leftmost(g, least, lo, w)
        over = hi > pos
    lo_all.append(lo), hi_all.append(hi), pos_all.append(pos)
    lo, hi, pos = (np.concatenate(x) for x in (lo_all, hi_all, pos_all))
    # keep windows inside one document
    doc = np.searchsorted(starts, lo, side="right") - 1
    return _inside(lo, hi, pos, doc, starts, window, g, roll)


def _leftmost(g, least, at, w):
    """For each window start in `at`: the leftmost p >= at with g[p] == least[at]."""
    p = at.copy()
    todo = np.flatnonzero(g[p] != least[at])
    off, step = 1, 16
    while len(todo) and off < w:
        cols = np.arange(off, min(off + step, w))
        idx = at[todo][:, None] + cols[None, :]
        eq = g[np.minimum(idx, len(g) - 1)] == least[at[todo]][:, None]
        has = eq.any(axis=1)
        hit = todo[has]
        p[hit] = at[hit] + off + eq[has].argmax(axis=1)
        todo = todo[~has]
        off += step
    return p


def _inside(lo, hi, pos, doc, starts, window, g, roll):
    out = []
    ends = starts[1:]
    while len(lo):
        last = ends[doc] - window                   # last window start of the document
        top = np.minimum(hi, last)
        ok = lo <= top
        out.append((doc[ok], pos[ok], lo[ok], top[ok]))
        nxt = ends[doc]                             # stretch may reach into later documents
        more = hi >= nxt
        lo, hi, pos = nxt[more], hi[more], pos[more]
        doc = np.searchsorted(starts, lo, side="right") - 1
    doc, pos, lo, hi = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out, strict=True))
    return doc, pos, lo, hi, g[pos], roll
