"""Distributed running sums: for every row, the sum of a weight over the rows
before it, per key, without a one-task window."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.iterate import cut_to_table
from . import textops as T


def _running(keys: np.ndarray, weights: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """Sum of the earlier weights of the same key; ``seen`` carries the sums of
    earlier batches."""
    o = np.argsort(keys, kind="stable")
    w = weights[o]
    ids, first, count = np.unique(keys[o], return_index=True, return_counts=True)
    total = np.cumsum(w)
    base = np.repeat(total[first] - w[first] - np.array([seen.get(int(i), 0) for i in ids], np.int64), count)
    out = np.empty(len(keys), np.int64)
    out[o] = total - w - base
    last = total[first + count - 1] - total[first] + w[first]
    for i, s in zip(ids, last):
        seen[int(i)] = seen.get(int(i), 0) + int(s)
    return out


def prefix_sums(rows: DataFrame, sums: list[tuple[str, str, str]], order: str | None = None) -> DataFrame:
    """Adds, for each (name, key, weight) of ``sums``, the column ``name``:
    the sum of ``weight`` over the preceding rows with the same ``key`` (an
    int column; few distinct values).  Rows are in the order of ``order``
    (nulls first, by a range partitioning), or as they lie in their partitions.

    Each task numbers its own rows; the totals per (partition, key) give the
    offsets, one small row each.  The numbered rows are written before their
    totals are taken, so a recomputed task cannot number them otherwise."""
    names = [n for n, _, _ in sums]

    def number(batches):
        seen = [{} for _ in sums]
        for b in batches:
            if b.num_rows:
                col = lambda c: b.column(c).to_numpy(zero_copy_only=False)
                local = [_running(col(f"_k{i}"), col(f"_w{i}"), s) for i, s in enumerate(seen)]
                yield T.batch([*b.schema.names, *(f"_l{i}" for i in range(len(sums)))], [*b.columns, *local])

    if order is not None:
        by = F.col(order).asc_nulls_first()
        rows = rows.repartitionByRange(by).sortWithinPartitions(by)
    cols = rows.columns
    src = rows.select(*cols, F.spark_partition_id().cast("long").alias("_p"),
                      *(F.col(k).cast("int").alias(f"_k{i}") for i, (_, k, _) in enumerate(sums)),
                      *(F.col(w).cast("long").alias(f"_w{i}") for i, (_, _, w) in enumerate(sums)))
    schema = StructType([*src.schema.fields, *(StructField(f"_l{i}", LongType()) for i in range(len(sums)))])
    done = cut_to_table(src.mapInArrow(number, schema))
    out = done
    for i, name in enumerate(names):
        before = Window.partitionBy(f"_bk{i}").orderBy(f"_bp{i}").rowsBetween(Window.unboundedPreceding, -1)
        base = (done.groupBy(F.col("_p").alias(f"_bp{i}"), F.col(f"_k{i}").alias(f"_bk{i}")).agg(F.sum(f"_w{i}").alias("_t"))
                .select(f"_bp{i}", f"_bk{i}", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias(f"_b{i}")))
        # one row per (partition, key): bounded by the number of tasks, not by the data
        out = out.join(F.broadcast(base), (F.col("_p") == F.col(f"_bp{i}")) & (F.col(f"_k{i}") == F.col(f"_bk{i}")))
        out = out.withColumn(name, F.col(f"_l{i}") + F.col(f"_b{i}"))
    return out.select(*cols, *names)
