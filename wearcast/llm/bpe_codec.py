"""BPE encoding and decoding: contiguous rank array.

A word is held as a row of symbols and, beside it, the ranks of the adjacent
pairs.  The least rank is sought again and again (leftmost on ties), the
boundary between its two symbols is deleted, and the ranks of the two pairs
next to it are looked up anew.  Short words of a batch (up to SHORT symbols)
are the rows of one numpy matrix, so that a step of the scan runs over all of
them at once; longer words use a heap over the same ranks, as rescanning would
be quadratic there.  Words already encoded by a task are kept in a bounded
table.

Pre-tokenisation follows the JSON file of the vocabulary: added tokens first,
then NFC, lower case, and the split pattern; a word's last symbol carries the
end-of-word suffix.  Decoding joins the token strings with one space (the file
names no decoder).

Null texts are empty: no ids, the empty string.  Repeated rows and ids are
encoded each for itself, an empty table gives an empty result, and other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, record, texts, utf8

SHORT = 24             # symbols of a word that goes into the matrix
CACHE_WORDS = 400_000  # words kept in a task
NONE = np.int32(2**31 - 1)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the rest for 256, 257, ..."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordBPE:
    def __init__(self, path: str):
        import regex

        with open(path) as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int32)
        self.last = np.array([vocab[c + suffix] for c in chars], dtype=np.int32)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in [*vocab.items(), *added.items()]:
            self.strings[i] = token
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        keys, order = np.unique(left << 32 | right, return_index=True)
        self.keys, self.ranks = keys, order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)  # by rank
        # ranks of pairs of single bytes, which every word starts with, by direct address
        single = np.concatenate([self.inner, self.last])
        self.single = np.full(int(single.max()) + 1, -1, dtype=np.int32)
        self.single[single] = np.arange(512)
        self.first = self.rank(np.repeat(single, 512), np.tile(single, 512)).reshape(512, 512)
        self.special_ids = {k: np.array([v], dtype="<u4").tobytes() for k, v in added.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        patterns = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(patterns[0])
        # Letters and numbers of a newer Unicode than Python's: the tokenizers library says
        # which of them it knows (the others are symbols there, so private-use ones here)
        # and how it lower-cases them.
        from tokenizers import Regex, normalizers, pre_tokenizers

        newer = [c for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
                 if unicodedata.category(c) == "Cn"]
        known, lower = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed"), normalizers.Lowercase()
        hidden = [c for c in newer if known.pre_tokenize_str(c)]
        place = dict(zip(hidden, range(0x100000, 0x100000 + len(hidden)), strict=True))
        self.show = {v: k for k, v in place.items()}
        self.hide = {ord(c): place.get(lower.normalize_str(c), place[c]) for c in hidden}
        self.hide |= {ord(c): low for c in newer if c not in hidden and (low := lower.normalize_str(c)) != c}
        self.newer = frozenset(newer)
        self.known: dict[str, bytes] = {}

    # -------------------------------------------------------- pre-tokens --
    def split(self, text: str) -> list[str]:
        """Words of a text that holds no added token."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:                       # lower-cased by character: no final sigma
            text = text.replace("Σ", "σ")
        if _latin1(text) or self.newer.isdisjoint(text):
            return self.words.findall(text.lower())
        return [w.translate(self.show) for w in self.words.findall(text.lower().translate(self.hide))]

    def parts(self, text: str) -> list[tuple[bool, list[str]]]:
        """(is an added token, words) in order."""
        if self.specials is None or not self.specials.search(text):
            return [(False, self.split(text))]
        return [(bool(i % 2), [x] if i % 2 else self.split(x)) for i, x in enumerate(self.specials.split(text))]

    # ------------------------------------------------------------- merges --
    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian uint32) of words of 1 to SHORT bytes."""
        n = np.array([len(w) for w in words])
        width = int(n.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(-1, width)
        cols = np.arange(width)
        ids = np.where(cols[None, :] < n[:, None], self.inner[raw], np.int32(-1))
        at = np.arange(len(words))
        ids[at, n - 1] = self.last[raw[at, n - 1]]
        out = ids.copy()                                # rows are written back as they end
        size = n.copy()
        live = at
        ranks = np.full((len(words), width), NONE, dtype=np.int32)  # last column stays NONE
        if width > 1:
            slot = np.where(ids >= 0, self.single[ids], 0)
            ranks[:, :-1] = np.where(cols[None, 1:] < n[:, None], self.first[slot[:, :-1], slot[:, 1:]], NONE)
        while len(live):
            j = ranks.argmin(axis=1)
            rows = np.arange(len(live))
            best = ranks[rows, j]
            go = best != NONE
            if not go.all():
                out[live[~go]] = ids[~go]
                live, ids, ranks, j, best = live[go], ids[go], ranks[go], j[go], best[go]
                rows = np.arange(len(live))
                if not len(live):
                    break
            ids[rows, j] = self.made[best]
            # delete the boundary: shift what stands right of it
            src = np.minimum(cols[None, :] + (cols[None, :] > j[:, None]), width - 1)
            ids = np.take_along_axis(ids, src, axis=1)
            ids[:, -1] = -1
            ranks = np.take_along_axis(ranks, src, axis=1)
            ranks[:, -1] = NONE
            size[live] -= 1
            # refresh the two neighbouring ranks
            nxt = np.minimum(j + 1, width - 1)
            ranks[rows, j] = np.where(j + 1 < width, self.rank(ids[rows, j], ids[rows, nxt]), NONE)
            has = np.flatnonzero(j > 0)
            ranks[has, j[has] - 1] = self.rank(ids[has, j[has] - 1], ids[has, j[has]])
        flat = out.astype("<u4").tobytes()
        step = 4 * width
        return [flat[i * step:i * step + 4 * k] for i, k in enumerate(size.tolist())]

    def merge_long(self, word: bytes) -> bytes:
        """The same merges over a heap of (rank, position), for long words."""
        ids = self.inner[np.frombuffer(word, dtype=np.uint8)].tolist()
        ids[-1] = int(self.last[word[-1]])
        n = len(ids)
        nxt, prv, dead = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        arr = np.array(ids, dtype=np.int32)
        first = self.rank(arr[:-1], arr[1:])
        heap = [(int(r), i) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)
        current = dict(enumerate(first.tolist()))

        def look(i: int) -> None:
            j = nxt[i]
            r = int(self.rank(np.array([ids[i]], dtype=np.int32), np.array([ids[j]], dtype=np.int32))[0]) if j < n else int(NONE)
            current[i] = r
            if r != NONE:
                heapq.heappush(heap, (r, i))

        while heap:
            r, i = heapq.heappop(heap)
            if dead[i] or current.get(i) != r:
                continue
            j = nxt[i]
            ids[i] = int(self.made[r])
            dead[j] = 1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            look(i)
            if prv[i] >= 0:
                look(prv[i])
        return np.array([x for x, d in zip(ids, dead, strict=True) if not d], dtype="<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Encodes words that are not in the table yet."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = list(words)
        raw = [w.encode() for w in new]
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        for lo in range(0, len(order), 8192):           # rows of like width together
            part = order[lo:lo + 8192]
            short = [i for i in part if len(raw[i]) <= SHORT]
            if short:
                for i, ids in zip(short, self.merge_short([raw[i] for i in short]), strict=True):
                    self.known[new[i]] = ids
            for i in part[len(short):]:
                self.known[new[i]] = self.merge_long(raw[i])

    # ------------------------------------------------------ whole texts ---
    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        parts = [self.parts(t) for t in batch]
        words: set[str] = set()
        for doc in parts:
            for special, found in doc:
                if not special:
                    words.update(found)
        self.learn(words)
        get = self.known.__getitem__
        return [b"".join(self.special_ids[found[0]] if special else b"".join(map(get, found)) for special, found in doc)
                for doc in parts]

    def decode(self, ids: bytes | np.ndarray) -> str:
        ids = np.frombuffer(ids, dtype="<u4") if isinstance(ids, bytes) else ids
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


def encode(docs: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>) of every row of docs."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def step(batch, codec):
        ids = codec.encode_batch([t.decode("utf-8", "replace") for t in texts(batch)])
        sizes = np.array([0, *(len(x) // 4 for x in ids)])
        flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), type=pa.int32()), flat)
        return record(out, batch.column("doc_id"), sizes[1:], lists)

    return map_batches(utf8(docs), step, "doc_id long, n_tokens long, ids array<int>", start=lambda: WordBPE(vocab_path))


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, text) of the ids of `encode`; null ids give the empty text."""
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        codec = WordBPE(vocab_path)
        for batch in batches:
            ids = [np.array(x or [], dtype=np.int64) for x in batch.column("ids").to_pylist()]
            yield record(out, batch.column("doc_id"), [codec.decode(x) for x in ids])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Encodes, then decodes the ids; digests of both instead of the (larger) ids and texts."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def step(batch, codec):
        ids = codec.encode_batch([t.decode("utf-8", "replace") for t in texts(batch)])
        return record(out, batch.column("doc_id"), [len(x) // 4 for x in ids],
                      [hashlib.sha256(x).hexdigest() for x in ids],
                      [hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in ids])

    return map_batches(utf8(docs), step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
                       start=lambda: WordBPE(vocab_path))
