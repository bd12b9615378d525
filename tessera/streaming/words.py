"""Text and counting streams (ST7-ST13).  Builders work on batch and
streaming DataFrames alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import instant_to_ntz
from ..operators.learn import WHITESPACE
from .pageviews import event_time


def word_counts(docs: DataFrame, text_col: str = "text", pattern: str = WHITESPACE) -> DataFrame:
    """ST7: words of whole texts split on whitespace, counted."""
    w = docs.select(F.explode(F.split(F.col(text_col), pattern)).alias("word"))
    return w.filter(F.length("word") > 0).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def running_counts(docs: DataFrame, seed: DataFrame, text_col: str = "text", pattern: str = WHITESPACE) -> DataFrame:
    """ST8: running word counts that start from an initial state ``(word, n)``.
    The state enters the same aggregation as the words (a stream of its own
    when the documents are one), so it is part of the query's state and
    survives a restart with it."""
    w = docs.select(F.explode(F.split(F.col(text_col), pattern)).alias("word"), F.lit(1).cast("long").alias("n"))
    return w.filter(F.length("word") > 0).unionByName(seed.select("word", "n")).groupBy("word").agg(F.sum("n").alias("n"))


def mod_buckets(df: DataFrame, col: str, modulus: int = 10) -> DataFrame:
    """ST9: counts of ``col % modulus``."""
    return (df.groupBy(F.pmod(F.col(col), F.lit(modulus)).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n")))


def grep_count(streams: list[DataFrame], text_col: str, needle: str) -> DataFrame:
    """ST10: union several (merged) streams, keep rows containing
    ``needle``, count them."""
    u = reduce(lambda a, b: a.unionByName(b), streams)
    return u.filter(F.col(text_col).contains(needle)).agg(F.count(F.lit(1)).alias("n"))


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """ST11 (exact side): count per key; the top-k is ranked afterwards on
    the (small, per-key) result."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def approx_heavy_hitters(df: DataFrame, key: str, k: int = 10,
                         max_tracked: int = 10000) -> DataFrame:
    """ST11 (sketch side): approximate top-k with a bounded summary."""
    return df.agg(F.expr(f"approx_top_k({key}, {k}, {max_tracked})").alias("top"))


def count_min(df: DataFrame, key: str, eps: float = 0.001, confidence: float = 0.99,
              seed: int = 1) -> DataFrame:
    """ST11: count-min sketch of ``key`` (fixed size, mergeable)."""
    return df.agg(F.count_min_sketch(F.col(key), F.lit(eps), F.lit(confidence), F.lit(seed)).alias("cms"))


def distinct_exact(df: DataFrame, key: str) -> DataFrame:
    """ST12 (exact side): dedupe keys in keyed state, count the survivors."""
    return df.select(key).dropDuplicates([key]).agg(F.count(F.lit(1)).alias("n_distinct"))


def distinct_hll(df: DataFrame, key: str, lg_k: int = 12) -> DataFrame:
    """ST12 (sketch side): HyperLogLog estimate (sketch state is a few KB
    regardless of the key count)."""
    return df.agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.col(key), lg_k)).alias("n_estimate"))


def tag_counts(events: DataFrame, length: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """ST13: tag (``props.k``) counts per window; state older than the
    watermark goes."""
    e = event_time(events)
    e = (e.withWatermark("et", watermark) if watermark else e).withColumn("tag", F.get_json_object("props", "$.k").cast("long"))
    w = F.window("et", length, slide) if slide else F.window("et", length)
    a = e.filter(F.col("tag").isNotNull()).groupBy(w, "tag").agg(F.count(F.lit(1)).alias("n"))
    return a.select(instant_to_ntz(F.col("window.start")).alias("w_start"), "tag", "n")
