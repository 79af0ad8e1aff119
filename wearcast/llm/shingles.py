"""Word shingles as sorted 64-bit hashes (numpy), one set per document."""

from __future__ import annotations

import numpy as np
import xxhash

from .anchors import mix


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each UTF-8 text.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text
    of fewer than `width` words is one shingle, a text without words has none.
    """
    words = [t.lower().split() for t in texts]
    flat = [w for ws in words for w in ws]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), dtype=np.uint64, count=len(flat))
    m = max(0, len(h) - width + 1)
    s = mix(h[:m] + np.uint64(width))
    for k in range(1, width):
        s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[k:k + m])
    out, at = [], 0
    for ws in words:
        n = len(ws)
        if n >= width:
            out.append(np.unique(s[at:at + n - width + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=n)], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


class OnePermutation:
    """One-permutation hashing: the hash range is cut into bands * rows bins and
    a set's signature is the least hash of each bin.  An empty bin borrows from
    the first bin that is not empty in a random order of its own (optimal
    densification), the same order for every set."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        self.bands, self.rows, k = bands, rows, bands * rows
        self.edges = np.array([(i << 64) // k for i in range(k)], dtype=np.uint64)
        rng = np.random.default_rng(seed)
        self.order = rng.permuted(np.tile(np.arange(k, dtype=np.int32), (k, 1)), axis=1)

    def signature(self, s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(s, self.edges)
        full = np.diff(at, append=len(s)) > 0
        if full.all():
            return s[at]
        own, empty = np.flatnonzero(full), np.flatnonzero(~full)
        pick = np.arange(len(full))
        pick[empty] = own[self.order[np.ix_(empty, own)].argmin(axis=1)]
        return s[at[pick]]

    def band_keys(self, sets: list[np.ndarray]) -> np.ndarray:
        """One 64-bit key for each band of each (non-empty) set."""
        sig = np.stack([self.signature(s) for s in sets]).reshape(len(sets), self.bands, self.rows)
        key = mix(sig[:, :, 0] + np.arange(self.bands, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03))
        for r in range(1, self.rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
        return key.view(np.int64)


ODD_WORDS = 16  # longs of an odd sketch


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Bit i says whether an odd number of hashes fall into cell i.  Cells in
    which two sketches differ hold at least one hash that only one set has, so
    their number never exceeds the size of the symmetric difference."""
    cells = 64 * ODD_WORDS
    odd = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)
