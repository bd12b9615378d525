"""Readers for the shared test tables.

Every table is one Parquet file (or folder) under ``sf_dir``.  We read lazily
and let Catalyst prune columns and push filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


class Tables:
    """Attribute access to the tables of one scale: ``t.lineitem``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return load(self.spark, self.sf_dir, name)
        raise AttributeError(name)

    def register(self, names=TABLES) -> None:
        """SNK3 / SRC3: expose tables as temp views for ``spark.sql``."""
        for n in names:
            load(self.spark, self.sf_dir, n).createOrReplaceTempView(n)

    def list_tables(self) -> list[str]:
        """SRC3 ``show tables`` on the session catalog."""
        return sorted(t.name for t in self.spark.catalog.listTables())


def spread(df: DataFrame, target: int | None = None) -> DataFrame:
    """Spread a CPU-heavy input over the cluster's cores.

    A scan yields one task per file split, and a file of one row group cannot
    be split.  When a scan has fewer splits than there are cores, the rows are
    dealt round-robin to ``target`` partitions (default: the cluster's
    parallelism).  That is a shuffle of the selected columns: select before
    spreading.  With more splits than cores (a smaller
    ``spark.sql.files.maxPartitionBytes`` gives more) nothing happens.
    """
    target = target or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df
