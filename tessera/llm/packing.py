"""Hierarchical multi-length packing (operator 9).

Documents become token ids plus an end id.  Their full windows of the longest
tier stand alone; each document's rest is routed to the smallest tier
(a power of two) that holds it.  Rests above a cut-off length anchor one window
of their tier and stay whole; the shorter ones are fillers.  The fillers, laid
end to end, fill the anchors' gaps, the longest tier's first, cut wherever a
gap ends; what is left over is packed into windows of the longest tier, and a
last, incomplete window is split into powers of two.  The cut-off is the
smallest length at which the fillers' tokens cover all gaps; it comes from a
histogram with one row per length.  So every sequence is exactly as long as its
tier and needs no padding.  Sequences of one tier form step groups of equal
token counts.

Gaps and fillers are intervals on one line per job, placed by distributed
running sums and met by a join on line buckets: no task sees more than a
bucket's share, whatever the documents' sizes are.

Edge cases: a null or empty text is its end id alone; null ids and repeated
rows are packed row by row; an empty table gives no pieces; other input
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.iterate import cut_to_table
from . import textops as T
from .prefix import prefix_sums
from .tokens import Encoder

WINDOW = 1024
SHORTEST_TIER = 1
BUCKET = 8192  # tokens of the line per join bucket
STEP_TOKENS = 8 * WINDOW  # tokens of a step group


def tokenise(docs: DataFrame, window: int = WINDOW, end_id: int = 0, tokenizer: str | None = None,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its token count ``n`` (end id included), the CRC-32 of
    each full window, and the rest's length, CRC-32 and ids."""
    def task(batches):
        enc = Encoder(tokenizer)
        end = np.array([end_id], dtype="<u4")
        for b in T.pieces(batches, "text"):
            n, crcs, lens, rest_crc, rest = [], [], [], [], []
            for text in b.column("text").to_pylist():
                ids = np.concatenate([enc.encode(text or ""), end])
                full = len(ids) // window * window
                raw = ids.tobytes()
                n.append(len(ids))
                crcs.append([zlib.crc32(raw[4 * i:4 * (i + window)]) for i in range(0, full, window)])
                lens.append(len(ids) - full)
                rest_crc.append(zlib.crc32(raw[4 * full:]))
                rest.append(raw[4 * full:])
            yield T.batch(["doc_id", "n", "crcs", "rest_len", "rest_crc", "rest"], [
                b.column("doc_id"), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())),
                pa.array(lens, pa.int32()), pa.array(rest_crc, pa.int64()), pa.array(rest, pa.binary())])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(task, f"doc_id {kind}, n long, crcs array<bigint>, rest_len int, rest_crc long, rest binary")


def tier_of(length: int, window: int = WINDOW) -> int:
    """The smallest tier, a power of two, that holds ``length`` tokens."""
    return min(window, max(SHORTEST_TIER, 1 << max(0, length - 1).bit_length()))


def plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[int, dict[int, int], int]:
    """(cut-off, gap tokens of each tier, filler tokens): rests longer than the
    cut-off are anchors, the others fillers."""
    cut = 0
    supply, demand = 0, sum(c * (tier_of(x, window) - x) for x, c in histogram.items())
    for length in sorted(histogram):
        if supply >= demand:
            break
        cut = length
        supply += length * histogram[length]
        demand -= (tier_of(length, window) - length) * histogram[length]
    gaps: dict[int, int] = {}
    for x, c in histogram.items():
        if x > cut:
            gaps[tier_of(x, window)] = gaps.get(tier_of(x, window), 0) + c * (tier_of(x, window) - x)
    return cut, gaps, supply


def _by_tier(values: dict[int, int], key, other: int = 0):
    """A column that maps a tier to its value (at most one entry per tier)."""
    out = F.lit(other).cast("long")
    for k, v in values.items():
        out = F.when(key == k, F.lit(v).cast("long")).otherwise(out)
    return out


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = 0, tokenizer: str | None = None,
         step_tokens: int = STEP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, tier, step_group."""
    spark = docs.sparkSession
    tok = cut_to_table(tokenise(docs, window, end_id, tokenizer, id_col, text_col))
    hist = {r.rest_len: r["count"] for r in tok.filter("rest_len > 0").groupBy("rest_len").count().collect()}  # one row per length below the window
    cut, gaps, supply = plan(hist, window)

    tiers = [1 << i for i in range(window.bit_length()) if SHORTEST_TIER <= 1 << i <= window]
    tier = F.lit(window)
    for t in sorted(tiers, reverse=True):
        tier = F.when(F.col("rest_len") <= t, F.lit(t)).otherwise(tier)
    anchor = F.col("rest_len") > cut
    filler = (F.col("rest_len") > 0) & ~anchor
    rows = (tok.withColumn("_tier", F.when(anchor, tier).otherwise(F.lit(0)))
            .withColumn("_gap", F.when(anchor, F.col("_tier") - F.col("rest_len")).otherwise(F.lit(0)))
            .withColumn("_fill", F.when(filler, F.col("rest_len")).otherwise(F.lit(0)))
            .withColumn("_full", F.size("crcs"))
            .withColumn("_is", F.when(anchor, F.lit(1)).otherwise(F.lit(0)))
            .withColumn("_seqs", F.col("_full") + F.col("_is"))
            .withColumn("rest", F.when(filler, F.col("rest"))).withColumn("_zero", F.lit(0)))
    rows = prefix_sums(rows, [("seq0", "_zero", "_seqs"), ("gap0", "_tier", "_gap"), ("fill0", "_zero", "_fill"),
                              ("full0", "_zero", "_full"), ("at0", "_tier", "_is")])
    n_full, n_seq = tok.agg(F.coalesce(F.sum(F.size("crcs")), F.lit(0)), F.coalesce(
        F.sum(F.size("crcs") + F.when(anchor, F.lit(1)).otherwise(F.lit(0))), F.lit(0))).first()

    # places on the line: the gaps tier by tier, then the left-over windows
    line, gap_base = 0, {}
    for t in sorted(gaps, reverse=True):
        gap_base[t] = line
        line += gaps[t]
    left = supply - line
    n_left, last = divmod(left, window)
    bits = [1 << i for i in range(last.bit_length() - 1, -1, -1) if last >> i & 1]  # the last window as powers of two
    per = lambda t: max(1, step_tokens // t)
    anchors = {t: sum(c for x, c in hist.items() if x > cut and tier_of(x, window) == t) for t in tiers}
    count = {t: anchors[t] + (n_full + n_left if t == window else 0) + bits.count(t) for t in tiers}
    group_base, g = {}, 0
    for t in sorted(tiers, reverse=True):
        group_base[t] = g
        g += -(-count[t] // per(t))
    group = lambda key, at: (_by_tier(group_base, key) + F.floor(at / _by_tier({t: per(t) for t in tiers}, key, 1))).cast("long")
    longest = F.lit(window)

    full = (rows.filter("_full > 0").select("doc_id", "n", "seq0", "full0", F.posexplode("crcs").alias("_i", "ids_crc32"))
            .select("doc_id", (F.col("_i") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"),
                    "ids_crc32", F.col("n").alias("doc_tokens"), (F.col("seq0") + F.col("_i")).alias("sequence_id"),
                    F.lit(0).cast("long").alias("offset"), longest.alias("tier"), group(longest, F.col("full0") + F.col("_i")).alias("step_group")))
    at = F.col("at0") + F.when(F.col("_tier") == window, F.lit(n_full)).otherwise(F.lit(0))
    held = rows.filter("_is = 1").select(
        "doc_id", "n", "rest_len", "rest_crc", (F.col("seq0") + F.col("_full")).alias("sequence_id"), "_tier", "_gap",
        (_by_tier(gap_base, F.col("_tier")) + F.col("gap0")).alias("_g0"), group(F.col("_tier"), at).alias("step_group"))
    whole = held.select("doc_id", (F.col("n") - F.col("rest_len")).alias("start"), F.col("rest_len").cast("long").alias("length"),
                        F.col("rest_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id",
                        F.lit(0).cast("long").alias("offset"), F.col("_tier").alias("tier"), "step_group")

    holes = held.filter("_gap > 0").select("_g0", F.col("_gap").cast("long").alias("_gap"), F.col("rest_len").cast("long").alias("_o0"),
                                           "sequence_id", F.col("_tier").alias("tier"), "step_group")
    more = spark.range(n_left).select(
        (F.lit(line) + F.col("id") * window).alias("_g0"), F.lit(window).cast("long").alias("_gap"), F.lit(0).cast("long").alias("_o0"),
        (F.lit(n_seq) + F.col("id")).alias("sequence_id"), longest.alias("tier"),
        group(longest, F.lit(n_full + anchors[window]) + F.col("id")).alias("step_group"))
    holes = holes.unionByName(more)
    pos = line + n_left * window
    if bits:
        ends = []
        for i, size in enumerate(bits):
            index = anchors[size] + (n_full + n_left if size == window else 0)
            ends.append((pos, size, 0, n_seq + n_left + i, size, group_base[size] + index // per(size)))
            pos += size
        holes = holes.unionByName(spark.createDataFrame(ends, "_g0 long, _gap long, _o0 long, sequence_id long, tier int, step_group long"))
    fills = rows.filter("_fill > 0").select("doc_id", "n", "rest", F.col("rest_len").cast("long").alias("_len"), "fill0")
    buckets = lambda a, size: F.explode(F.sequence(F.floor(a / BUCKET), F.floor((a + size - 1) / BUCKET)))
    met = (holes.withColumn("_b", buckets(F.col("_g0"), F.col("_gap")))
           .join(fills.withColumn("_fb", buckets(F.col("fill0"), F.col("_len"))),
                 (F.col("_b") == F.col("_fb")) & (F.col("_g0") < F.col("fill0") + F.col("_len"))
                 & (F.col("fill0") < F.col("_g0") + F.col("_gap"))
                 & (F.floor(F.greatest("_g0", "fill0") / BUCKET) == F.col("_b")))
           .withColumn("_a", F.greatest("_g0", "fill0"))
           .withColumn("length", F.least(F.col("_g0") + F.col("_gap"), F.col("fill0") + F.col("_len")) - F.col("_a"))
           .withColumn("_from", F.col("_a") - F.col("fill0"))
           .select("doc_id", (F.col("n") - F.col("_len") + F.col("_from")).alias("start"), "length",
                   F.crc32(F.substring(F.col("rest"), (F.col("_from") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))).alias("ids_crc32"),
                   F.col("n").alias("doc_tokens"), "sequence_id", (F.col("_o0") + F.col("_a") - F.col("_g0")).alias("offset"), "tier", "step_group"))
    return full.unionByName(whole).unionByName(met)
