"""BPE encoding with content-defined chunk reuse (operator 7).

Texts are cut where a rolling hash of the last bytes meets a mask, so equal
passages have equal chunks wherever they stand.  The chunks whose repeats save
most across all documents (exactly the ``DICTIONARY`` best, ties by hash, of at
most ``CHUNK_BYTES`` each) are encoded once and sent to every task.  A document
is then put together from dictionary chunks and freshly encoded stretches.

Tokens near a chunk's edge depend on its neighbours.  So a chunk lends only the
ids between its first and its last certain token boundary (a single space
between visible ASCII characters, where every encoding starts a token); the
joins between are repaired by encoding from one chunk's last certain boundary
to the next one's first, further chunks included where one has none.  The ids
are therefore exactly those of encoding the whole text.

Chunks beyond the dictionary are encoded in place, so the bound costs time and
never changes a result.  No text is shuffled: only chunk hashes and counts are.

Edge cases: a null or empty text has no ids; null ids and repeated rows are
encoded row by row; very long texts without boundaries are encoded whole; an
empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.iterate import cut_to_table
from . import textops as T
from .tokens import Encoder

MASK = 511  # a cut every 512 bytes, on average
SPAN = 32  # bytes that the rolling hash sees
CHUNK_BYTES = 4096  # longest chunk of the dictionary
DICTIONARY = 16_384  # chunks of the dictionary

_GEAR = T.mix(np.arange(1, 257, dtype=np.uint64))
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the chunks of all texts of a slice, in order.  A cut
    depends on the SPAN bytes before it alone (fewer at a text's start)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _GEAR[data]
    step = 1
    while step < SPAN:  # h[i] = sum of gear[data[i - j]] << j for j < step, doubled each time
        h[step:] = h[step:] + (h[:-step] << np.uint64(step))
        step *= 2
    here = (h >> np.uint64(SPAN)) & np.uint64(MASK) == 0
    at = np.flatnonzero(here) + 1  # a cut follows the byte
    first = offsets[:-1]
    inner = at[at < n]
    inner = inner[(data[inner] & 0xC0) != 0x80]
    doc = np.searchsorted(offsets, inner, side="right") - 1
    inner = inner[inner - first[doc] >= SPAN]
    edges = np.unique(np.concatenate([inner, offsets]))
    return edges[:-1], edges[1:]


def _safe(data: np.ndarray) -> np.ndarray:
    """Positions of spaces that surely start a token."""
    ok = np.zeros(len(data), bool)
    if len(data) > 2:
        see = _VISIBLE[data]
        ok[1:-1] = (data[1:-1] == 32) & see[:-2] & see[2:]
    return ok


def chunk_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, n, size): how often each chunk occurs, within or across documents."""
    def task(batches):
        for b in T.pieces(batches, "text"):
            data, offsets = T.byte_view(b.column("text"))
            s, e = cuts(data, offsets)
            fit = e - s <= CHUNK_BYTES
            s, e = s[fit], e[fit]
            h, first, n = np.unique(T.run_hashes(data, s, e).view(np.int64), return_index=True, return_counts=True)
            yield T.batch(["h", "n", "size"], [h, n.astype(np.int64), (e - s)[first].astype(np.int64)])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(task, "h long, n long, size long")
    return rows.groupBy("h").agg(F.sum("n").alias("n"), F.max("size").alias("size"))


def best_chunks(saved: DataFrame, limit: int) -> np.ndarray:
    """The hashes of the ``limit`` rows (h, saved) that save most, ties to the
    smaller hash.  The threshold is narrowed by histograms of ``saved``, then of
    the hashes at it: each is a few thousand rows at most, and only rows of the
    answer and of one last narrow range come to the driver, not a list a task."""
    cells = 4096

    def narrow(rows: DataFrame, name: str, low: int, high: int, need: int):
        """(first, last) of ranges of ``name``, best first: taken whole, and the
        one where the limit falls (at most ``limit`` rows, or one value)."""
        taken, step = [], -(-(high - low + 1) // cells)
        while True:
            cell = F.expr(f"cast((cast({name} as decimal(20,0)) - {low}) div {step} as int)")
            count = {r.cell: r["count"] for r in rows.filter(F.col(name).between(low, high)).groupBy(cell.alias("cell")).count().collect()}
            for c in sorted(count):
                first, last = low + c * step, min(high, low + (c + 1) * step - 1)
                if count[c] > need:
                    break
                taken.append((first, last))
                need -= count[c]
            else:
                return taken, None, need
            if not need:
                return taken, None, 0
            if first == last or count[c] <= limit:
                return taken, (first, last, count[c]), need
            low, high, step = first, last, -(-(last - first + 1) // cells)

    rows = saved.select("h", (-F.col("saved")).alias("cost"))
    span = rows.agg(F.min("cost").alias("low"), F.max("cost").alias("high")).first()
    if span.low is None or not limit:
        return np.zeros(0, np.int64)
    taken, edge, need = narrow(rows, "cost", span.low, span.high, limit)
    inside = F.lit(False)
    if taken:
        inside = F.col("cost").between(taken[0][0], taken[-1][1])
    got = [rows.filter(inside).select("h")]
    if edge:
        tied = rows.filter(F.col("cost").between(*edge[:2]))
        if edge[2] > limit:  # one cost that too many chunks share: the smallest hashes
            spans, last, need = narrow(tied, "h", -(1 << 63), (1 << 63) - 1, need)
            if spans:
                got.append(tied.filter(F.col("h").between(spans[0][0], spans[-1][1])).select("h"))
            tied = tied.filter(F.col("h").between(*last[:2])) if last else tied.limit(0)
        got.append(tied.orderBy("cost", "h").limit(need).select("h"))
    return np.sort(np.array([r.h for part in got for r in part.collect()], dtype=np.int64))


def build_dictionary(docs: DataFrame, tokenizer: str | None = None, limit: int = DICTIONARY, text_col: str = "text") -> dict[bytes, tuple[int, int, bytes]]:
    """chunk bytes -> (first and last certain boundary, ids between), for the
    ``limit`` chunks whose repeats save most bytes.  Each is encoded once, by
    the task that its hash falls to.  At most limit * CHUNK_BYTES bytes of
    text, and an id for each byte at the very worst, come to the driver."""
    spark = docs.sparkSession
    saved = cut_to_table(chunk_counts(docs, text_col).filter("n > 1").withColumn("saved", (F.col("n") - 1) * F.col("size")))
    best = best_chunks(saved, limit)
    if not len(best):
        return {}
    wanted = spark.sparkContext.broadcast(best)

    def find(batches):
        seen = set()
        for b in T.pieces(batches, "text"):
            data, offsets = T.byte_view(b.column("text"))
            s, e = cuts(data, offsets)
            fit = e - s <= CHUNK_BYTES
            s, e = s[fit], e[fit]
            h = T.run_hashes(data, s, e).view(np.int64)
            hit = np.flatnonzero(np.isin(h, wanted.value))
            hit = hit[np.unique(h[hit], return_index=True)[1]]
            hit = [i for i in hit if int(h[i]) not in seen]
            seen.update(int(h[i]) for i in hit)
            yield T.batch(["h", "chunk"], [pa.array(h[hit], pa.int64()), pa.array([data[s[i]:e[i]].tobytes() for i in hit], pa.binary())])

    def encode(batches):
        enc = Encoder(tokenizer)
        for b in batches:
            out = []
            for c in b.column("chunk").to_pylist():
                at = np.flatnonzero(_safe(np.frombuffer(c, np.uint8)))
                lo, hi = (int(at[0]), int(at[-1])) if len(at) > 1 else (0, 0)
                out.append((c, lo, hi, enc.encode(c[lo:hi].decode()).tobytes()))
            chunk, lo, hi, ids = zip(*out) if out else ((), (), (), ())
            yield T.batch(["chunk", "lo", "hi", "ids"], [pa.array(chunk, pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(ids, pa.binary())])

    once = (docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(find, "h long, chunk binary")
            .groupBy("h").agg(F.min("chunk").alias("chunk")))
    rows = once.select("chunk").mapInArrow(encode, "chunk binary, lo int, hi int, ids binary").collect()
    return {bytes(r.chunk): (r.lo, r.hi, bytes(r.ids)) for r in rows if r.hi > r.lo}


class Reuser:
    """Encodes slices of texts with a chunk dictionary."""

    def __init__(self, dictionary: dict[bytes, tuple[int, int, bytes]], tokenizer: str | None = None):
        self.enc = Encoder(tokenizer)
        self.known = {c: (lo, hi, np.frombuffer(ids, "<u4")) for c, (lo, hi, ids) in dictionary.items()}
        text = b"".join(self.known)
        ends = np.cumsum([len(c) for c in self.known], dtype=np.int64)
        starts = ends - np.array([len(c) for c in self.known], dtype=np.int64)
        self.hashes = np.sort(T.run_hashes(np.frombuffer(text, np.uint8), starts, ends))
        self.reused = self.total = 0

    def encode_all(self, col: pa.Array):
        """The ids of each text of a slice."""
        data, offsets = T.byte_view(col)
        s, e = cuts(data, offsets)
        hit = np.zeros(len(s), bool)
        if len(self.hashes) and len(s):
            fit = e - s <= CHUNK_BYTES
            hit[fit] = np.isin(T.run_hashes(data, s[fit], e[fit]), self.hashes)
        hs, he = s[hit], e[hit]
        first = np.searchsorted(hs, offsets)
        for i in range(len(offsets) - 1):
            a, z = int(offsets[i]), int(offsets[i + 1])
            self.total += z - a
            parts, at = [], a
            for k in range(first[i], first[i + 1]):
                known = self.known.get(data[hs[k]:he[k]].tobytes())
                if known is None:
                    continue
                lo, hi = int(hs[k]) + known[0], int(hs[k]) + known[1]
                if lo > at:  # repair: from the last certain boundary to this chunk's first
                    parts.append(self.enc.encode(data[at:lo].tobytes().decode()))
                parts.append(known[2])
                self.reused += hi - lo
                at = hi
            if z > at:
                parts.append(self.enc.encode(data[at:z].tobytes().decode()))
            yield np.concatenate(parts) if parts else np.zeros(0, "<u4")


def encode_documents(docs: DataFrame, tokenizer: str | None = None, limit: int = DICTIONARY,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text."""
    known = docs.sparkSession.sparkContext.broadcast(build_dictionary(docs, tokenizer, limit, text_col))

    def task(batches):
        reuser = Reuser(known.value, tokenizer)
        names = [str(i) for i in range(reuser.enc.top + 1)]
        for b in T.pieces(batches, "text"):
            n, ids_sha, text_sha = [], [], []
            for ids in reuser.encode_all(b.column("text")):
                ids = ids.tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(reuser.enc.decode(ids).encode()).hexdigest())
            yield T.batch(["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                          [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(task, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
