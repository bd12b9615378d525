"""Run a Structured Streaming query over the files available now and hand
its result back as a (batch) DataFrame.

Results are written by ``foreachBatch`` into the session's shared
checkpoint folder, one directory per epoch (overwrite, so a replayed epoch
after a failure rewrites its own output: exactly-once), and read back from
there — nothing passes through driver memory (no memory sink).
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..session import scratch_path
from ..sources.tables import table_path


def table_stream(spark: SparkSession, sf_dir: str, name: str,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """SRC17: a table, a folder of Parquet files or one file, as a file stream
    (schema taken from the files, as a stream needs it up front; a missing
    table is an error)."""
    path = table_path(sf_dir, name)
    schema = spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        path = f"{path[:-1]}[{path[-1]}]"  # the file source takes folders or patterns; this one is the file's own name
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def dir_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
               max_files_per_trigger: int | None = None) -> DataFrame:
    """SRC18: watch a directory (train or test folder)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def arrivals_by(df: DataFrame, by: str) -> tuple[str, StructType, list]:
    """(folder, schema, arrivals): a folder to watch, and one call for every
    value of ``by``, in order, that makes the value's rows arrive in it.

    The table is read once and written by value beside the folder; an arrival
    moves a value's directory in, so its files become visible together and
    are one micro-batch.  The list has one entry per value of ``by``."""
    spark = df.sparkSession
    base = scratch_path(spark, "arrivals")
    df.write.partitionBy(by).parquet(f"{base}/staged")
    jvm = spark._jvm
    path = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{base}/arrived"))
    names = [f.getPath().getName() for f in fs.listStatus(path(f"{base}/staged")) if f.isDirectory()]
    field = df.schema[by].dataType.simpleString()
    order = sorted(names, key=lambda n: int(n.split("=")[1]) if field in ("int", "bigint") else n)

    def arrive(name: str) -> None:
        if not fs.rename(path(f"{base}/staged/{name}"), path(f"{base}/arrived/{name}")):
            raise RuntimeError(f"{name} could not be moved into {base}/arrived")

    schema = StructType([f for f in df.schema.fields if f.name != by])
    return f"{base}/arrived", schema, [partial(arrive, n) for n in order]


def watch(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the files in a folder and the folders below it."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def drive(writer: DataStreamWriter, arrivals=None):
    """Run a stream to its end: over what is there now, or as one query over
    ``arrivals`` (calls that make input arrive), each of them one or more
    micro-batches that are finished before the next.  Returns the query."""
    if arrivals is None:
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
        return q
    q = writer.start()
    try:
        for arrive in arrivals:
            arrive()
            q.processAllAvailable()
    finally:
        q.stop()
    return q


def run_to_table(df: DataFrame, mode: str = "complete",
                 per_batch=None, keys: list[str] | None = None, arrivals=None) -> DataFrame:
    """Run ``df`` (a streaming DataFrame) to its end (``drive``: over the files
    there are, or over ``arrivals``) and return its result.

    * ``complete``: the last epoch holds the whole answer;
    * ``update`` (needs ``keys``): each epoch writes only the groups it
      changed — the output per batch stays proportional to the batch, not to
      the state — and the answer is the latest row per key;
    * ``append``: the union of all epochs;
    * ``per_batch(batch_df, epoch) -> DataFrame``: SNK5, a callback applied
      to every micro-batch; its outputs are unioned with a ``batch`` column.
    """
    if mode == "update" and not keys:
        raise ValueError("update mode needs the group keys")
    spark = df.sparkSession
    base = scratch_path(spark, "stream")
    last = -1

    def sink(bdf: DataFrame, epoch: int) -> None:
        nonlocal last
        out = bdf if per_batch is None else per_batch(bdf, epoch)
        if per_batch is not None or mode == "update":
            out = out.withColumn("batch", F.lit(epoch).cast("long"))
        out.write.mode("overwrite").parquet(f"{base}/out/e{epoch:09d}")
        last = max(last, epoch)

    drive(df.writeStream.outputMode("append" if per_batch is not None else mode)
          .foreachBatch(sink).option("checkpointLocation", f"{base}/chk"), arrivals)
    if last < 0:
        raise RuntimeError("the stream found no input")
    if mode == "complete" and per_batch is None:
        return spark.read.parquet(f"{base}/out/e{last:09d}")
    out = spark.read.parquet(f"{base}/out/e*")
    if mode == "update" and per_batch is None:
        vals = [c for c in df.columns if c not in keys]
        latest = out.groupBy(*keys).agg(F.max_by(F.struct(*vals), F.col("batch")).alias("_v"))
        return latest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in vals])
    return out


def head_per_batch(df: DataFrame, n: int = 10, order: list[str] | None = None) -> DataFrame:
    """SNK4 / SRT5: the first ``n`` rows of every micro-batch (ordered by
    ``order`` so the pick is deterministic), with the batch id."""
    def first(b: DataFrame, epoch: int) -> DataFrame:
        return (b.orderBy(*order) if order else b).limit(n)
    return run_to_table(df, per_batch=first)
