"""Session construction and the shared folders every job writes to.

On a cluster the session already names a shared checkpoint folder in
``spark.checkpoint.dir``; we only ever read it.  A folder of our own is made
only when the setting is missing (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


# Settings for large clusters (e.g. ~1000 executors reading ~100 TB).  Shuffle
# partitions start high and AQE coalesces them towards the advisory size, so
# every reduce task handles ~256 MB whatever the query's selectivity; skewed
# join partitions beyond 4x the median (and 512 MB) are split; file splits of
# 256 MB keep scan tasks large enough to amortise scheduling; runtime
# broadcasts stay under a fixed 64 MB so no broadcast grows with the data.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # superseded loop states go
    "spark.ui.enabled": "false",
}


def cluster_session(app: str = "tessera", extra: dict | None = None) -> SparkSession:
    """Session for a real cluster: master, executors and the shared
    ``spark.checkpoint.dir`` come from the submitting environment; only the
    query-planning settings above are applied."""
    b = SparkSession.builder.appName(app)
    for k, v in {**CLUSTER_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    checkpoint_root(spark)
    return spark


def build_session(master: str | None = None, app: str = "tessera",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session tuned for the operators in this package.

    AQE is on so shuffle partitions coalesce at run time, skewed join
    partitions get split, and broadcast decisions are taken from measured
    (not estimated) sizes.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.default.parallelism", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEM", "16g"))
         .config("spark.driver.bindAddress", "127.0.0.1")
         .config("spark.driver.host", "127.0.0.1")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.sql.streaming.forceDeleteTempCheckpointLocation", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir).
    When neither is set, a session on a local master gets a folder of its own
    (tests, laptops); on a cluster that is an error, because executors would
    not see a folder on the driver's disk.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf = sc.getConf().get("spark.checkpoint.dir", None) or \
        spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (never machine-local
    unless the session itself is local)."""
    root = checkpoint_root(spark)
    return f"{root.rstrip('/')}/tessera-{kind}-{uuid.uuid4().hex[:12]}"
