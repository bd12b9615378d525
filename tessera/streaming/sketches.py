"""Mergeable sketches over streams (ST11, ST12): each micro-batch is reduced to
a sketch of fixed size, batches' sketches are stored and merged.

* Count-min: ``depth`` rows of ``width`` counters as a table (row, cell, n), so
  merging is a sum by cell.  A key's estimate is its smallest cell; it is never
  below the count, and above it by more than e / width of all rows with
  probability e^-depth at most.  Heavy hitters need no second look at the
  stream: a key with a share of ``phi`` of the whole has it in some batch, so
  the batches' hitters are the candidates.
* HyperLogLog: Spark's sketch aggregate per batch, and its union over batches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 2147483647
# Fixed values of the cells' hash: (a key + b) mod PRIME mod width, a row each.
HASHES = ((1103515245, 12345), (1664525, 1013904223), (22695477, 1), (214013, 2531011), (69069, 5))


def cells(key: Column, width: int, depth: int = len(HASHES)) -> Column:
    """The cell of an integer key in every row of the sketch."""
    k = F.pmod(key.cast("long"), F.lit(PRIME))
    return F.array(*((k * a + b) % PRIME % width for a, b in HASHES[:depth]))


def count_min(df: DataFrame, key: str, width: int, by: tuple[str, ...] = (), depth: int = len(HASHES)) -> DataFrame:
    """(*by, row, cell, n): a count-min sketch for every group ``by``."""
    counted = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    return (counted.select(*by, "n", F.posexplode(cells(F.col(key), width, depth)).alias("row", "cell"))
            .groupBy(*by, "row", "cell").agg(F.sum("n").alias("n")))


def merge(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return sketches.groupBy(*by, "row", "cell").agg(F.sum("n").alias("n"))


def estimates(keys: DataFrame, key: str, sketch: DataFrame, width: int, by: tuple[str, ...] = (), depth: int = len(HASHES)) -> DataFrame:
    """(*by, key, estimate, total): the estimate of each key and the sketch's
    number of rows, in every group ``by``."""
    at = keys.select(*by, key, F.posexplode(cells(F.col(key), width, depth)).alias("row", "cell"))
    total = sketch.filter("row = 0").groupBy(*by).agg(F.sum("n").alias("total"))
    found = at.join(sketch, [*by, "row", "cell"]).groupBy(*by, key).agg(F.min("n").alias("estimate"))
    return found.join(total, list(by)) if by else found.crossJoin(total)  # one row


def error_bound(total: Column, width: int) -> Column:
    """What an estimate exceeds the count by, at most (but for e^-depth)."""
    return F.ceil(F.lit(math.e / width) * total).cast("long")


def heavy_batch(batch: DataFrame, key: str, phi: float, width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """A micro-batch's sketch cells (``hit`` null) and its heavy hitters
    (``hit``: a key estimated at ``phi`` of a group's rows or more)."""
    own = count_min(batch, key, width, by)
    hits = estimates(batch.select(*by, key).distinct(), key, own, width, by).filter(F.col("estimate") >= phi * F.col("total"))
    return (own.withColumn("hit", F.lit(None).cast("long"))
            .unionByName(hits.select(*by, F.col(key).cast("long").alias("hit")), allowMissingColumns=True))


def heavy_hitters(batches: DataFrame, phi: float, width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, key, estimate, total): the heavy hitters of the merged sketches of
    all ``heavy_batch`` results."""
    sketch = merge(batches.filter("hit is null"), by)
    keys = batches.filter("hit is not null").select(*by, F.col("hit").alias("key")).distinct()
    return estimates(keys, "key", sketch, width, by).filter(F.col("estimate") >= phi * F.col("total"))


def distinct_batch(batch: DataFrame, key: str, by: tuple[str, ...] = (), lg_k: int = 12) -> DataFrame:
    """A micro-batch's HyperLogLog sketch for every group ``by``."""
    return batch.groupBy(*by).agg(F.hll_sketch_agg(F.col(key), lg_k).alias("sketch"))


def distinct_union(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, estimate) of the union of stored sketches."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
