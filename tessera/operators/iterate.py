"""Loop support for iterative operators.

Each iteration extends the logical plan; after a few steps the plan (and
the lineage a lost executor would replay) grows without bound.  We cut it
with a *reliable* checkpoint into the session's shared checkpoint folder,
so a lost executor re-reads the last written state instead of replaying
every earlier iteration.
"""

from __future__ import annotations

import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_root


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to the shared checkpoint folder and return a
    DataFrame that starts from it (eager: the write happens now)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


class Loop:
    """Helper that cuts lineage every ``every`` iterations."""

    def __init__(self, every: int = 1):
        self.every = max(1, every)
        self.i = 0

    def step(self, df: DataFrame, force: bool = False) -> DataFrame:
        self.i += 1
        if force or self.i % self.every == 0:
            return cut(df)
        return df


def rounds(limit: int | None, what: str) -> Iterator[int]:
    """Rounds of a loop that breaks at its fixpoint.  Without a limit they go
    on; with one, exceeding it is an error, never an unfinished answer."""
    n = 0
    while limit is None or n < limit:
        yield n
        n += 1
    raise RuntimeError(f"{what}: not finished after {limit} rounds")


@contextmanager
def small_tasks(spark: SparkSession, rows: int, each: int = 500_000) -> Iterator[None]:
    """Within it a task of a shuffle or a file scan gets about ``each`` of ``rows``
    rows, whatever the session's settings are for the table sizes it knows: the
    memory of a task then does not grow with the data.  Only for plans that run
    inside; AQE still merges small partitions."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", str(max(int(old["spark.sql.shuffle.partitions"]), -(-rows // each))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")  # two long columns that repeat take a few bytes a row
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it Spark deletes the shuffle files of every query as soon as it has
    ended, not when the driver's JVM happens to collect its plan: a loop of written
    states then takes the disk of one step, not of all.  For results that are written
    or collected once; a plan that runs inside must not be run again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def join_plain(big: DataFrame, side: DataFrame, on) -> DataFrame:
    """Inner join with a grouped side of one row per key, which is written
    first.  AQE splits a hot key's partition only where both sides of the join
    are plain shuffles; below an aggregate it cannot."""
    return big.join(cut_to_table(side), on)


def cut_to_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back: a fresh relation with no lineage (columnar, compressed, and its
    columns get new identities, which self-joins of loop state need)."""
    from ..session import scratch_path
    path = scratch_path(df.sparkSession, "state")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)  # the schema is known: no job to infer it
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    return out


_PATHS: dict[int, str] = {}


def is_table(df: DataFrame) -> bool:
    """Whether ``df`` is a table just as ``cut_to_table`` returned it."""
    return id(df) in _PATHS


def release(df: DataFrame) -> None:
    """Delete a table made by ``cut_to_table`` that nothing will read again (a
    superseded loop state)."""
    path = _PATHS.pop(id(df), None)
    if path is not None:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def hold(df: DataFrame) -> DataFrame:
    """Keep a loop-invariant input (an edge table hash-partitioned by its
    join key) for the whole loop: persisted in memory and on disk, so every
    iteration joins against it without shuffling it again (the cache keeps
    the partitioning, a checkpoint would not).  Hand it a cut table, so that a
    lost block is rebuilt by one shuffle of written data."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    return df
