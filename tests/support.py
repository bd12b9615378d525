"""Helpers that test modules import by name (``conftest`` is ambiguous: each
test folder has one)."""

SF_SMALL = "/root/testdata/sf0.001"


def rows(df, *cols):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def shuffle_files(spark):
    """Names of the shuffle files on this machine's disk."""
    at = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {at.apply(i).getName() for i in range(at.size()) if at.apply(i).getName().startswith("shuffle_")}
