"""Generic relational building blocks (caching, set difference, top-n,
bucket splits, global ranks).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Storage-level names accepted by the reference programs and
# the level each one selects (NONE means "do not persist").
STORAGE_LEVELS = {
    "NONE": None,
    "MEMORY_ONLY": StorageLevel.MEMORY_ONLY,
    "MEMORY_ONLY_2": StorageLevel.MEMORY_ONLY_2,
    "MEMORY_ONLY_SER": StorageLevel.MEMORY_ONLY,
    "MEMORY_AND_DISK": StorageLevel.MEMORY_AND_DISK,
    "MEMORY_AND_DISK_2": StorageLevel.MEMORY_AND_DISK_2,
    "MEMORY_AND_DISK_SER": StorageLevel.MEMORY_AND_DISK,
    "DISK_ONLY": StorageLevel.DISK_ONLY,
    "OFF_HEAP": StorageLevel.OFF_HEAP,
}


def storage_level(name: str):
    """CCH2: storage level by name; unknown names are rejected."""
    key = name.strip().upper()
    if key not in STORAGE_LEVELS:
        raise ValueError(f"unknown storage level {name!r}")
    return STORAGE_LEVELS[key]


def stage(df: DataFrame, name: str, level: str = "NONE",
          partitions: int | None = None, force: bool = True) -> DataFrame:
    """CCH1/CCH3: optionally repartition, persist at ``level``, force by a
    count, and register as temp view ``name``.  The uncached path only
    registers the view (Catalyst then inlines it)."""
    if partitions:
        df = df.repartition(partitions)
    lvl = storage_level(level)
    if lvl is not None:
        df = df.persist(lvl)
        if force:
            df.count()
    df.createOrReplaceTempView(name)
    return df


_SLICE = 1 << 20  # rows that a task holds at once in distinct_counts


def distinct_counts(df: DataFrame, cols: dict[str, str], rows: str | None = None) -> DataFrame:
    """AGG8: exact ``count(distinct col) as name`` for each ``{name: col}`` of
    whole-number columns, and ``rows``, the row count, in one row.

    Spark's own plan of several exact distincts expands each row once a column.
    Here each row is read once: a task reduces a slice's values to 64-bit words, a
    bit a value (dense ids: 2 bits an id cross the shuffle; ids far apart: 16 bytes),
    and words of one key are or-ed before and after the shuffle.  Nulls do not count.
    """
    whole = ("tinyint", "smallint", "int", "bigint")
    if bad := [c for c in cols.values() if df.schema[c].dataType.simpleString() not in whole]:
        raise TypeError(f"whole-number columns only, not {bad}")

    def words(held):
        block = pa.Table.from_batches(held)
        yield -1, np.zeros(1, np.int64), np.zeros(1, np.int64), block.num_rows
        for i, c in enumerate(block.columns):
            ids = np.unique(c.drop_null().to_numpy())
            key, first = np.unique(ids >> 6, return_index=True)
            if len(key):
                yield i, key, np.bitwise_or.reduceat(np.int64(1) << (ids & 63), first), 0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                n += batch.num_rows
            if held and (batch is None or n >= _SLICE):
                for i, key, word, count in words(held):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i, np.int32)), pa.array(key), pa.array(word),
                                                      pa.array(np.full(len(key), count, np.int64))], ["col", "key", "word", "n"])
                held, n = [], 0

    narrow = df.select(*[F.col(c).cast("long").alias(f"c{i}") for i, c in enumerate(cols.values())])
    merged = (narrow.mapInArrow(task, "col int, key long, word long, n long").groupBy("col", "key")
              .agg(F.bit_or("word").alias("word"), F.sum("n").alias("n")))
    bits = [F.coalesce(F.sum(F.when(F.col("col") == i, F.bit_count("word"))), F.lit(0)).cast("long").alias(name)
            for i, name in enumerate(cols)]
    return merged.agg(*([F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias(rows)] if rows else []), *bits)


def subtract_all_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """JN10 / SET2: RDD ``subtract`` — drop every left row that equals some
    right row (all duplicates go), keep the rest with multiplicity.  A
    null-safe anti join on all columns; ``exceptAll`` would only remove one
    copy per right row."""
    cond = reduce(lambda a, b: a & b,
                  [left[c].eqNullSafe(right[c]) for c in left.columns])
    return left.join(right, cond, "left_anti")


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column],
                    n: int, rank_col: str = "rank") -> DataFrame:
    """SRT6: first ``n`` rows per group under ``order``.

    ``row_number() <= n`` lets Spark plan a partial WindowGroupLimit before
    the shuffle, so at most n rows per group leave each map task even when
    one group holds a large share of the input.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w))
              .filter(F.col(rank_col) <= n)
              .withColumn(rank_col, F.col(rank_col).cast("long")))


def bucket_split(df: DataFrame, key: Column, buckets: dict[str, tuple[int, int]],
                 modulus: int = 10, name: str = "split") -> DataFrame:
    """FLT6: deterministic split by ``key % modulus`` into named half-open
    ranges, e.g. {"train": (0, 6), "validation": (6, 8), "test": (8, 10)}."""
    b = F.pmod(key, F.lit(modulus))
    expr = None
    for label, (lo, hi) in buckets.items():
        cond = (b >= lo) & (b < hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return df.withColumn(name, expr)


def global_row_number(df: DataFrame, order: list[str], parts: int | None = None,
                      name: str = "rank") -> DataFrame:
    """Rank of every row in a total order (1-based), by one range shuffle.

    Range partitioning puts each contiguous key range in its own partition,
    where the rows are sorted; ``monotonically_increasing_id`` then holds the
    partition in its high bits and the local rank in its low 33.  The rows are
    written with that id (a checkpoint in the shared folder), and the rows
    before each partition come from a table with one row per partition.
    """
    from .iterate import cut
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    r = cut(ranged.sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    per = r.groupBy(part.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    off = F.broadcast(per.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off")))
    return (r.withColumn("_pid", part).join(off, "_pid")
            .withColumn(name, F.col("_off") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
            .drop("_pid", "_m", "_off"))
