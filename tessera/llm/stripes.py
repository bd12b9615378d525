"""Stripes: associative next-word counters, shared by the phrase miner
(operator 11) and the language model (operator 12).

A stripe belongs to a prefix and maps what follows it to a count.  Stripes of
the same prefix are merged elementwise.  Words are 64-bit hashes inside a
stripe; a stripe travels as one row with two binary columns, ``nexts`` (the
entries' hashes) and ``counts`` (as many unsigned 32-bit numbers), whose Arrow
buffers are the concatenated entries of a whole batch.

A prefix that may hold more than a small share of all entries is split into
shards by its first next word (``hot_words`` finds such prefixes, ``shard_of``
deals them), so no stripe is merged whole in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.iterate import cut_to_table
from . import textops as T

END = np.uint64(0)  # follows a piece's or a text's last word
TOKENS = 1 << 20  # tokens that a task combines before it emits stripes

_U = np.uint64


def least_share(spark) -> float:
    """A quarter of a shuffle partition's part of all tokens."""
    return 1.0 / (4 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def frequent(hashes: np.ndarray, share: float) -> pa.RecordBatch:
    """(h, n) of the words that have more than half of ``share`` of a slice's
    tokens, and a row (null, number of tokens).  The slices in which a word has
    less hold at most half a share of it, so a word with the whole share is
    still counted to half of it or more."""
    h, n = np.unique(hashes, return_counts=True)
    hit = n > share / 2 * len(hashes)
    return T.batch(["h", "n"], [pa.array([*h[hit].view(np.int64).tolist(), None], pa.int64()),
                                pa.array([*n[hit].tolist(), len(hashes)], pa.int64())])


def hot_words(rows: DataFrame, share: float) -> dict[int, int]:
    """word hash -> number of shards, from the (h, n) of all slices: every word
    with more than ``share`` of all tokens is here, and at most 2 / share words
    are, so the result is bounded by the number of shuffle partitions, not by
    the data.  It says where rows go and never changes a result."""
    sums = cut_to_table(rows.groupBy("h").agg(F.sum("n").alias("n")))
    total = sums.filter("h is null").select("n").collect()
    if not total or not total[0].n:
        return {}
    least = share / 2 * total[0].n
    hot = sums.filter(F.col("h").isNotNull() & (F.col("n") >= least)).collect()
    return {r.h: int(2 * r.n // (share * total[0].n)) + 2 for r in hot}


def shard_of(prefix: np.ndarray, following: np.ndarray, hot: dict[int, int]) -> np.ndarray:
    """The shard of each entry: 0, or for hot prefixes one by the next word."""
    out = np.zeros(len(prefix), np.int32)
    if hot and len(prefix):
        keys = np.array(sorted(hot), dtype=np.int64)
        size = np.array([hot[int(k)] for k in keys], dtype=_U)
        p = prefix.view(np.int64)
        at = np.minimum(np.searchsorted(keys, p), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == p)
        out[hit] = (T.mix(following[hit] + _U(1)) % size[at[hit]]).astype(np.int32)
    return out


def sum_by(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their numbers."""
    if not len(keys):
        return keys, n
    o = np.argsort(keys, kind="stable")
    k = keys[o]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(n[o], first)


def starts(*columns: np.ndarray) -> np.ndarray:
    """Positions at which any of the sorted columns changes."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings at [start, end) of ``data``."""
    size = end - start
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    offsets = np.zeros(len(size) + 1, np.int32)
    offsets[1:] = ends
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[at].tobytes())])


def as_binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column whose rows are consecutive parts of ``values``; row i
    ends before entry ends[i]."""
    size = values.dtype.itemsize
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends * size
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def entries(col: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all entries of a binary column in a row, number of entries a row)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = col.type in (pa.large_binary(), pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0]:off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), dtype), np.diff(off) // np.dtype(dtype).itemsize


def halves(values: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Non-negative numbers as two binary columns: low bytes, and the rest.
    Most counts are small, so the rest is mostly zeros, which a shuffle
    compresses away."""
    values = values.astype(np.int64)
    return as_binary((values & 255).astype(np.uint8), ends), as_binary(values >> 8, ends)


def whole(low: pa.Array, rest: pa.Array) -> np.ndarray:
    return entries(low, np.uint8)[0].astype(np.int64) + (entries(rest, np.int64)[0] << 8)


def by_key(batches, keys: list[str], weight: str, limit: int, compact=None):
    """Cut batches that are sorted by ``keys`` into tables of whole key groups
    with about ``limit`` bytes of the binary column ``weight`` (one key's
    rows stay together).  Rows of one key that pass the limit go through
    ``compact``, which may merge them, so that their number does not count."""
    held: list[pa.RecordBatch] = []
    size, enough = 0, limit
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.column(weight).nbytes
        if size < enough:
            continue
        t = pa.Table.from_batches(held)
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            c = t.column(k).combine_chunks()
            c = c.dictionary_encode().indices if pa.types.is_string(c.type) or pa.types.is_binary(c.type) else c
            c = c.to_numpy(zero_copy_only=False)
            change[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(change)
        if len(at):  # the last key may go on in the next batch
            yield t.slice(0, int(at[-1]))
            held = t.slice(int(at[-1])).to_batches()
            size, enough = sum(x.column(weight).nbytes for x in held), limit
        elif compact is not None and t.num_rows > 1:
            held = compact(t).to_batches()
            size = sum(x.column(weight).nbytes for x in held)
            enough = max(limit, 2 * size)
        else:
            enough = 2 * size
    if held:
        yield pa.Table.from_batches(held)
