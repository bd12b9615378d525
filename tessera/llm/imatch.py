"""Document fingerprints by I-Match with randomised lexicons (operator 6).

The lexicon holds the terms whose inverse document frequency lies in a band:
those in at least ``LOW`` and at most ``HIGH`` of all documents.  Each term of
it belongs to some of ``SUBSETS`` random sub-lexicons.  A document's signature
in a sub-lexicon is the hash of its sorted distinct terms that belong there; its
fingerprint lists the signatures.  Two fingerprints are as alike as the share of
sub-lexicons, among those in which either has a term, whose signatures are
equal.  Sub-lexicons of three densities serve short and long documents.

The lexicon is sent to every task; it has at most (mean distinct terms of a
document) / LOW terms, however many documents there are.

A document with no term in the band is fingerprinted over all its terms; one
with no term in any sub-lexicon has the hash of its terms as first signature.

Each document is compared with the next one by descending id and with its own
edited text.  Neighbours come from a range sort of the compressed texts; a
partition's last row meets the next partition's first in a join of two rows per
partition.

Edge cases: a null text is empty; an empty fingerprint is alike (1.0) to an
empty one only; repeated rows and ties are ordered by text, null ids come last;
a single document is its own next one; an empty table gives no rows; other
input columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..operators.iterate import cut_to_table
from . import textops as T

LOW, HIGH = 0.001, 0.2  # share of documents that hold a term of the lexicon
SUBSETS = 60
_RATES = (32, 128, 512)  # one term in so many belongs to a sub-lexicon; a third of them each

_SEEDS = T.mix(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LIMITS = np.array([(1 << 64) // _RATES[k * len(_RATES) // SUBSETS] for k in range(SUBSETS)], dtype=np.uint64)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df): how many documents hold a term; terms are 64-bit hashes of
    words, A-Z lower-cased."""
    def task(batches):
        for b in T.pieces(batches, "text"):
            h, n = np.unique(T.Words(b.column("text"), lower=True).shingles(1)[1], return_counts=True)
            yield T.batch(["term", "df"], [h.view(np.int64), n.astype(np.int64)])

    return (docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(task, "term long, df long")
            .groupBy("term").agg(F.sum("df").alias("df")))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, text_col: str = "text") -> np.ndarray:
    """The sorted terms within the band."""
    n = docs.count()
    rows = document_frequencies(docs, text_col).filter((F.col("df") >= F.lit(low * n)) & (F.col("df") <= F.lit(high * n)))
    return np.sort(rows.select("term").toPandas()["term"].to_numpy(dtype=np.int64).view(np.uint64))


def _short(total: np.ndarray) -> np.ndarray:
    return np.maximum((T.mix(total) >> np.uint64(32)).astype(np.uint32), 1)


def fingerprints(col: pa.Array, band: np.ndarray) -> np.ndarray:
    """(texts x SUBSETS) signatures, 0 where a sub-lexicon has no term."""
    first, terms = T.Words(col, lower=True).shingles(1)  # sorted distinct terms of each text
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    known = np.zeros(len(terms), bool)
    if len(band) and len(terms):
        at = np.minimum(np.searchsorted(band, terms), len(band) - 1)
        known = band[at] == terms
    some = np.bincount(doc[known], minlength=n) > 0
    use = known | ~some[doc]
    doc, terms = doc[use], terms[use]
    out = np.zeros((n, SUBSETS), dtype=np.uint32)
    begin = np.searchsorted(doc, np.arange(n))
    full = np.flatnonzero(np.bincount(doc, minlength=n))
    if not len(full):
        return out
    for k in range(SUBSETS):
        h = T.mix(terms ^ _SEEDS[k])
        inside = h < _LIMITS[k]
        # the terms are sorted and distinct, so this sum identifies their list
        total = np.add.reduceat(np.where(inside, T.mix(h), np.uint64(0)), begin[full])
        has = np.add.reduceat(inside.astype(np.int64), begin[full]) > 0
        out[full, k] = np.where(has, _short(total), 0)
    none = full[~out[full].any(axis=1)]
    if len(none):  # in no sub-lexicon: all its terms stand for the first
        out[none, 0] = _short(np.add.reduceat(T.mix(terms), begin[full]))[np.searchsorted(full, none)]
    return out


def packed(signatures: np.ndarray) -> pa.Array:
    """Fingerprints as bytes, four a signature (zero where there is none); their
    hexadecimal form is the text that queries return."""
    wide = signatures.astype(">u4")
    return pa.array([row.tobytes() for row in wide], pa.binary())


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: equal signatures among those that either side has."""
    either = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    return np.where(either > 0, same / np.maximum(either, 1), 1.0)


_FIELDS = [("n_chars", LongType()), ("edited_sha256", StringType()), ("fingerprint", BinaryType()),
           ("edited_fingerprint", BinaryType()), ("near_edited", DoubleType()), ("near_next", DoubleType())]


_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}


def _compare(ids: list, texts: list[str], following: list[str], band: np.ndarray, id_type: pa.DataType):
    """Output columns for documents and the documents next to them."""
    edited = []
    for t, u in zip(texts, following):
        k = len(t) // 3
        edited.append(t[:len(t) - k] + u[:k])
    own, other, nxt = (fingerprints(pa.array(x, pa.string()), band) for x in (texts, edited, following))
    return [pa.array(ids, id_type), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            packed(own), packed(other),
            pa.array(likeness(own, other)), pa.array(likeness(own, nxt))]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next."""
    spark = docs.sparkSession
    band = spark.sparkContext.broadcast(lexicon(docs, low, high, text_col))
    id_type = docs.schema[id_col].dataType
    names = ["doc_id", *(n for n, _ in _FIELDS)]

    def squeeze(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield T.batch(["doc_id", "z"], [b.column("doc_id"), pa.array([z.compress((t or "").encode()) for t in b.column("text").to_pylist()], pa.binary())])

    def unpack(raw: bytes) -> str:
        return zstandard.ZstdDecompressor().decompress(raw).decode()

    def sweep(batches):
        """Pairs each row with the one after it; the partition's first and last
        row leave their texts for the join with the neighbours."""
        held, part, kind = None, None, None
        edge = lambda what, row: T.batch([*names, "edge", "part", "z"], [
            pa.array([row[0]], kind), *(pa.nulls(1, _ARROW[t.typeName()]) for _, t in _FIELDS),
            pa.array([what]), pa.array([part], pa.int32()), pa.array([row[1]], pa.binary())])
        for b in batches:
            if not b.num_rows:
                continue
            kind = b.schema.field("doc_id").type
            ids, zs = b.column("doc_id").to_pylist(), b.column("z").to_pylist()
            if held is None:
                part = b.column("part")[0].as_py()
                yield edge("first", (ids[0], zs[0]))
            else:
                ids, zs = [held[0], *ids], [held[1], *zs]
            held = (ids[-1], zs[-1])
            at = 0
            while at < len(ids) - 1:  # about 1 MB of text at a time
                texts, size = [unpack(zs[at])], 0
                while at + len(texts) < len(ids) and size < T.PIECE_BYTES:
                    texts.append(unpack(zs[at + len(texts)]))
                    size += len(texts[-1])
                n = len(texts) - 1
                cols = _compare(ids[at:at + n], texts[:-1], texts[1:], band.value, kind)
                yield T.batch([*names, "edge", "part", "z"], [*cols, pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())])
                at += n
        if held is not None:
            yield edge("last", held)

    def meet(batches):
        for b in batches:
            for i in range(b.num_rows):
                texts, following = [unpack(b.column("z")[i].as_py())], [unpack(b.column("z2")[i].as_py())]
                yield T.batch(names, _compare([b.column("doc_id")[i].as_py()], texts, following, band.value, b.schema.field("doc_id").type))

    order = [F.col("doc_id").desc_nulls_last(), F.col("z")]
    kind = id_type.simpleString()
    src = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
           .mapInArrow(squeeze, f"doc_id {kind}, z binary").repartitionByRange(F.col("doc_id").desc_nulls_last())
           .sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    schema = StructType([StructField("doc_id", id_type), *(StructField(n, t) for n, t in _FIELDS), StructField("edge", StringType()),
                         StructField("part", IntegerType()), StructField("z", BinaryType())])
    swept = cut_to_table(src.mapInArrow(sweep, schema))
    edges = swept.filter("edge is not null")
    parts = sorted(r.part for r in edges.filter("edge = 'first'").select("part").collect())  # one number per task
    shown = [F.lower(F.hex(n)).alias(n) if n.endswith("fingerprint") else F.col(n) for n in names]
    if not parts:
        return swept.select(*shown)
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, following int")
    last = edges.filter("edge = 'last'").select("doc_id", "z", "part").join(after, "part")
    first = edges.filter("edge = 'first'").select(F.col("part").alias("following"), F.col("z").alias("z2"))
    joins = last.join(first, "following").select("doc_id", "z", "z2").mapInArrow(meet, StructType(schema.fields[:len(names)]))
    return swept.filter("edge is null").select(*names).unionByName(joins).select(*shown)
