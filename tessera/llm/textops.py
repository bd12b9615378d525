"""Vectorised text primitives on Arrow string columns.

Tasks receive Arrow batches; these helpers view a batch's text as one byte
array and find words, word hashes and k-word shingles with whole-array numpy
operations, so no Python loop runs per word.  Words are maximal runs of bytes
other than space and \\x09-\\x0D, which in UTF-8 is the same as by code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

_PRIME = 0x9E3779B97F4A7C15
_U = np.uint64
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pieces(batches, text: str, limit: int = PIECE_BYTES):
    """Cut Arrow batches into consecutive slices of about ``limit`` bytes of
    ``text`` (a longer single text stays whole), which bounds task memory."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the UTF-8 bytes of all texts in a row, and n + 1
    offsets into them; null texts are empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    n, at = len(col), col.offset
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[at:at + n + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` that do not cross a
    text's end."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before[edge] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of every [start, end): a polynomial hash from
    prefix sums modulo 2**64, then finalised together with the length."""
    n = len(data)
    power = np.cumprod(np.full(n + 1, _PRIME, dtype=_U))
    back = np.cumprod(np.full(n + 1, pow(_PRIME, -1, 1 << 64), dtype=_U))
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * power[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


class Words:
    """Words of a slice of texts: ``start``/``end`` byte positions, ``doc``
    (row within the slice), ``hash``; ``first`` has n + 1 word offsets."""

    def __init__(self, col: pa.Array, lower: bool = False):
        self.data, self.offsets = byte_view(col)
        if lower:
            self.data = lower_ascii(self.data)
        self.n = len(self.offsets) - 1
        self.inside = _WORD[self.data]
        self.start, self.end = spans(self.inside, self.offsets)
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.hash = run_hashes(self.data, self.start, self.end)
        self.first = np.searchsorted(self.doc, np.arange(self.n + 1))
        self.count = np.diff(self.first)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, hash) of each window of k words."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        h = np.zeros(m, dtype=_U)
        for j in range(k):
            h = h * _U(_PRIME) + self.hash[j:j + m]
        keep = np.flatnonzero(self.doc[:m] == self.doc[k - 1:])
        return keep, mix(h[keep])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct k-word shingles of every text, as (n + 1 offsets,
        hashes).  A text of fewer words has its whole word sequence as its
        one shingle; a text without words has none."""
        pos, h = self.windows(k)
        doc = self.doc[pos]
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(short):
            one = np.zeros(len(short), dtype=_U)
            for j in range(k - 1):
                has = self.count[short] > j
                at = self.first[short[has]] + j
                one[has] = one[has] * _U(_PRIME) + self.hash[at]
            one = mix(one + self.count[short].astype(_U) * _U(0xA0761D6478BD642F))
            doc, h = np.concatenate([doc, short]), np.concatenate([h, one])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[new], h[new]
        return np.searchsorted(doc, np.arange(self.n + 1)), h


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of true ``flags`` (one a byte) in each text."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)
