"""Sharding by jump consistent hashing (operator 4).

A row's shard depends on its key and the number of shards alone: no ring
table, and when shards are appended only the necessary fraction of rows
moves, each into a new shard.  Rows then get gapless slots in their shard from
a range sort and a table of per-partition counts, never from one task a shard.

Edge cases: a null key counts as key 0; a null text has size 1 and the CRC of
no bytes; repeated rows get the same shard and slots of their own; an empty
table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .prefix import prefix_sums

_LCG = 2862933555777941757  # fixed value of the published algorithm


def jump_hash(key: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, 0 to shards - 1 (Lamping and Veach 2014)."""
    if shards < 1:
        raise ValueError("at least one shard")
    k = key.astype(np.int64).view(np.uint64).copy()
    b = np.full(len(k), -1, dtype=np.int64)
    j = np.zeros(len(k), dtype=np.int64)
    live = np.arange(len(k))
    while len(live):
        b[live] = j[live]
        k[live] = k[live] * np.uint64(_LCG) + np.uint64(1)
        step = (k[live] >> np.uint64(33)).astype(np.float64) + 1.0
        j[live] = ((b[live] + 1) * (float(1 << 31) / step)).astype(np.int64)
        live = live[j[live] < shards]
    return b.astype(np.int32)


def assign(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, shard, and the shard it
    would have with one shard more."""
    def task(batches):
        for b in batches:
            key = b.column("k").to_numpy(zero_copy_only=False)
            yield T.batch(["doc_id", "size", "text_crc32", "shard", "grown_shard"],
                          [b.column("doc_id"), b.column("size"), b.column("text_crc32"),
                           jump_hash(key, shards), jump_hash(key, shards + 1)])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("k"),
                      (F.octet_length(text).cast("long") + 1).alias("size"),
                      F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return src.mapInArrow(task, "doc_id long, size long, text_crc32 long, shard int, grown_shard int")


def with_slots(rows: DataFrame, order: str = "doc_id", shard: str = "shard") -> DataFrame:
    """Adds ``slot``: the row's gapless place in its shard, by ``order``."""
    one = rows.withColumn("_one", F.lit(1))
    return prefix_sums(one, [("slot", shard, "_one")], order).drop("_one")


def op4_jump_hash(spark, docs: DataFrame, shards: int = 16) -> DataFrame:
    placed = with_slots(assign(docs, shards))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
