"""Line-oriented text formats the workloads read (SRC1-SRC12, SRC15, SRC17).

Every parser takes a DataFrame with one string column ``value`` (what
``spark.read.text`` yields) and returns typed columns using JVM-side string
functions only, so parsing stays inside whole-stage codegen and scales with
the number of input splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, partitions: int | None = None,
               line_sep: str | None = None) -> DataFrame:
    """SRC1: text scan; optional requested parallelism (``textFile(p, n)``);
    ``line_sep='\\n\\n'`` reads blank-line separated blocks (SRC15)."""
    r = spark.read
    if line_sep:
        r = r.option("lineSep", line_sep)
    df = r.text(path)
    return df.repartition(partitions) if partitions else df


def parse_delimited(lines: DataFrame, fields: list[tuple[str, str]],
                    sep: str = r"\|") -> DataFrame:
    """SRC2: split each line on ``sep`` (a regex) and cast by position.

    ``fields`` is ``[(name, type)]``; a type written ``double->long`` is read
    as a double and truncated (the order-item key is stored as ``12.0``).
    """
    parts = F.split(F.col("value"), sep)
    cols = []
    for i, (name, typ) in enumerate(fields):
        raw = parts.getItem(i)
        if "->" in typ:
            a, b = typ.split("->")
            cols.append(raw.cast(a).cast(b).alias(name))
        else:
            cols.append(raw.cast(typ).alias(name))
    return lines.select(*cols)


def parse_labeled_points(lines: DataFrame) -> DataFrame:
    """SRC6: ``(label,[f1,f2,...])`` → ``label double, features array<double>``."""
    m = F.regexp_extract("value", r"^\s*\(\s*([^,]+)\s*,\s*\[(.*)\]\s*\)\s*$", 1)
    body = F.regexp_extract("value", r"^\s*\(\s*([^,]+)\s*,\s*\[(.*)\]\s*\)\s*$", 2)
    feats = F.transform(F.split(body, r"\s*,\s*"), lambda s: s.cast("double"))
    return lines.select(m.cast("double").alias("label"), feats.alias("features"))


def format_labeled_points(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Inverse of :func:`parse_labeled_points` (used to build test text)."""
    body = F.concat_ws(",", *[F.col(c).cast("double").cast("string") for c in features])
    return df.select(F.concat(F.lit("("), F.col(label).cast("double").cast("string"),
                              F.lit(",["), body, F.lit("])")).alias("value"))


def parse_edge_list(lines: DataFrame, canonical: bool = False) -> DataFrame:
    """SRC4: whitespace separated ``src dst [attr]``; ``#`` lines skipped; the
    third column is ignored; duplicates kept.  ``canonical=True`` rewrites
    every edge to src < dst (what the reference forces)."""
    body = lines.filter(~F.col("value").startswith("#") &
                        (F.length(F.trim("value")) > 0))
    p = F.split(F.trim(F.col("value")), r"\s+")
    e = body.select(p.getItem(0).try_cast("long").alias("src"),
                    p.getItem(1).try_cast("long").alias("dst")).dropna()
    if canonical:
        e = e.select(F.least("src", "dst").alias("src"),
                     F.greatest("src", "dst").alias("dst"))
    return e


def parse_weighted_edges(lines: DataFrame, sep: str = "::") -> DataFrame:
    """SRC5: ``src::dst::weight``."""
    p = F.split("value", sep)
    return lines.select(p.getItem(0).cast("long").alias("src"),
                        p.getItem(1).cast("long").alias("dst"),
                        p.getItem(2).cast("double").alias("weight"))


def parse_dense_vectors(lines: DataFrame, sep: str = r"\s+",
                        min_dims: int = 2) -> DataFrame:
    """SRC7: numbers separated by ``sep``.  Lines with fewer than ``min_dims``
    numbers are dropped (the reference silently substitutes a constant point;
    we never invent data)."""
    nums = F.transform(F.split(F.trim("value"), sep), lambda s: s.try_cast("double"))
    ok = F.size(F.filter(nums, lambda x: x.isNotNull())) == F.size(nums)
    return (lines.filter(F.length(F.trim("value")) > 0)
                 .select(nums.alias("features"))
                 .filter(ok & (F.size("features") >= min_dims)))


def parse_ratings_csv(lines: DataFrame) -> DataFrame:
    """SRC8: ``user,item,rating``."""
    return parse_delimited(lines, [("user", "int"), ("item", "int"),
                                   ("rating", "double")], sep=",")


def parse_movielens(lines: DataFrame) -> DataFrame:
    """SRC9: ``user::item::rating::ts`` keeping ``ts % 10`` as split key."""
    p = F.split("value", "::")
    ts = p.getItem(3).cast("long")
    return lines.select(p.getItem(0).cast("int").alias("user"),
                        p.getItem(1).cast("int").alias("item"),
                        p.getItem(2).cast("double").alias("rating"),
                        F.pmod(ts, F.lit(10)).alias("bucket"))


def positive_ratings(ratings: DataFrame) -> DataFrame:
    """SRC10: personal ratings, keep rating > 0; an empty result is an error
    raised inside the job (no driver collect)."""
    kept = ratings.filter(F.col("rating") > 0)
    n = kept.limit(1).count()
    if n == 0:
        raise ValueError("no positive personal ratings")
    return kept


def parse_category_docs(lines: DataFrame, sep: str = "::::") -> DataFrame:
    """SRC11: ``category::::text``; lines without the separator are dropped;
    split with limit 2 (the text may contain the separator); words are the
    text split on a single space."""
    p = F.split("value", sep, 2)
    return (lines.filter(F.size(p) == 2)
                 .select(p.getItem(0).alias("category"),
                         p.getItem(1).alias("text"))
                 .withColumn("words", F.split("text", " ")))


def parse_id_names(lines: DataFrame) -> DataFrame:
    """SRC12: ``id,name`` side table."""
    p = F.split("value", ",", 2)
    return lines.select(p.getItem(0).cast("long").alias("id"),
                        p.getItem(1).alias("name"))


def parse_page_views(lines: DataFrame) -> DataFrame:
    """SRC17: ``url\\tstatus\\tzip\\tuser``."""
    p = F.split("value", "\t")
    return lines.select(p.getItem(0).alias("url"),
                        p.getItem(1).cast("int").alias("status"),
                        p.getItem(2).cast("int").alias("zip"),
                        p.getItem(3).cast("int").alias("user"))
