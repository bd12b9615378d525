"""Output helpers (SNK1, SNK3) and the sampling operators (SMP1, SMP2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_pairs_text(df: DataFrame, path: str, cols: list[str], sep: str = " ",
                     mode: str = "overwrite") -> None:
    """SNK1: a text directory with one ``id value`` line per row (each task
    writes its own part file)."""
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in cols]).alias("value")) \
        .write.mode(mode).text(path)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """SNK3: expose a result to SQL."""
    df.createOrReplaceTempView(name)
    return df


def bernoulli_sample(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """SMP1: sample without replacement, each row kept with ``fraction``."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def take_random(df: DataFrame, k: int, seed: int) -> DataFrame:
    """SMP2: exactly ``k`` rows chosen at random (seeded).  ``orderBy(...)
    .limit(k)`` plans a per-partition top-k before one small final merge,
    so only k rows per task move."""
    return df.withColumn("_r", F.rand(seed)).orderBy("_r").limit(k).drop("_r")
