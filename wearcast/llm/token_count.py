"""Token counts: overlap resynchronisation.

A huge document is encoded in overlapping chunks.  Each chunk gives the byte
offsets of its tokens; two neighbours are spliced at a boundary that both have
and that is proven stable: the byte before it is no white space and the byte
at it is ASCII white space.  In the byte-level pattern no pre-token runs
from a non-space into a space, so such a place is a boundary of the whole text
whatever stands left of it, and the pre-tokens right of it depend on the text
right of it alone.  Where the overlap holds no such place that both sides have
as a token boundary, it is doubled; in the end it covers the document.

The vocabulary comes as ranks for the tiktoken library or as a JSON file for
the tokenizers library; both hold the same merges, and the tests compare them.
Special strings inside a text count as one token each, as the tokenizers
library has it by default.

Null texts are empty: 0 bytes, 0 tokens.  Repeated rows and ids are counted
each for itself, an empty table gives an empty result, and other columns of
the input are not read.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, record, texts, utf8

CHUNK = 32 << 10      # bytes a chunk holds before its overlap
OVERLAP = 512         # bytes of overlap that are tried first
SPACES = frozenset(b" \t\n\r\x0b\x0c")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBPE:
    """Encoder of byte-level BPE: ranks file (base64 token, rank per line)."""

    def __init__(self, ranks_path: str, specials: tuple[str, ...] = ("<|endoftext|>",), pattern: str = PATTERN):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.sizes = np.zeros(max(ranks.values()) + 2, dtype=np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.special_id = len(self.sizes) - 1
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.specials = re.compile("|".join(map(re.escape, specials))) if specials else None

    def count(self, text: str) -> int:
        if self.specials is None or not self.specials.search(text):
            return len(self.encoding.encode_ordinary(text))
        return sum(len(self.encoding.encode_ordinary(x)) for x in self.specials.split(text)) + len(self.specials.findall(text))

    def boundaries(self, text: str) -> np.ndarray:
        """Byte offsets of the token ends of `text`, ascending, 0 first."""
        out, at = [np.zeros(1, dtype=np.int64)], 0
        cut = 0
        found = list(self.specials.finditer(text)) if self.specials else []
        for m in [*found, None]:
            part = text[cut:m.start() if m else len(text)]
            ends = at + np.cumsum(self.sizes[self.encoding.encode_ordinary(part)])
            out.append(ends)
            at += len(part.encode())
            if m:
                at += len(m[0].encode())
                out.append(np.array([at], dtype=np.int64))
                cut = m.end()
        return np.concatenate(out)


def _char_start(data: bytes, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def count_long(data: bytes, encoder: ByteBPE, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """Tokens of one UTF-8 text by overlapping chunks, and how many overlaps were widened."""
    total, widened = 0, 0
    start = 0                                        # a true boundary; all before it is counted
    size = chunk
    while True:
        end = _char_start(data, min(len(data), start + size))
        left = start + encoder.boundaries(data[start:end].decode())
        if end == len(data):
            return total + len(left) - 1, widened
        wide = overlap
        while True:
            back = _char_start(data, max(start, end - wide))
            right = back + encoder.boundaries(data[back:min(len(data), _char_start(data, end + wide))].decode())
            splice = _splice(data, left, right, end)
            if splice is not None or back == start:
                break
            wide *= 2
            widened += 1
        if splice is None:                           # no stable place in the whole chunk: take a longer one
            size *= 2
            widened += 1
            continue
        total += int(np.searchsorted(left, splice))
        start, size = splice, chunk


def _splice(data: bytes, left: np.ndarray, right: np.ndarray, end: int) -> int | None:
    common = np.intersect1d(left, right, assume_unique=False)
    for at in common[::-1].tolist():
        if at and at < end and data[at] in SPACES and data[at - 1] < 0x80 and data[at - 1] not in SPACES \
                and data[at - 1] > 0x1F and at > left[0]:
            return at
    return None


SCHEMA = "doc_id long, n_bytes long, n_tokens long, n_chunk_overlaps_widened long"


def count_tokens(docs: DataFrame, ranks_path: str, chunk: int = CHUNK, overlap: int = OVERLAP,
                 specials: tuple[str, ...] = ("<|endoftext|>",)) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_chunk_overlaps_widened) of every row of docs."""
    out = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_bytes", "n_tokens", "n_chunk_overlaps_widened")])

    def step(batch, encoder):
        n_bytes, n_tokens, widened = [], [], []
        for data in texts(batch):
            text = data.decode("utf-8", "replace")      # bytes that are no UTF-8 count as U+FFFD
            n, w = count_long(text.encode(), encoder, chunk, overlap) if len(data) > chunk else (encoder.count(text), 0)
            n_bytes.append(len(data)), n_tokens.append(n), widened.append(w)
        return record(out, batch.column("doc_id"), n_bytes, n_tokens, widened)

    return map_batches(utf8(docs), step, SCHEMA, start=lambda: ByteBPE(ranks_path, specials))


def json_specials(path: str) -> tuple[str, ...]:
    """Contents of the added tokens of a tokenizers JSON file."""
    with open(path) as f:
        return tuple(t["content"] for t in json.load(f)["added_tokens"])


__all__ = ["ByteBPE", "count_long", "count_tokens", "json_specials"]
