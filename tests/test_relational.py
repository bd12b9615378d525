import pytest
from pyspark.sql import functions as F

from support import rows
from tessera.operators import relational as R


def test_subtract_removes_all_equal_rows(spark):
    left = spark.createDataFrame([("x",), ("x",), ("y",)], "v string")
    right = spark.createDataFrame([("x",)], "v string")
    assert rows(R.subtract_all_equal(left, right)) == [("y",)]


def test_subtract_is_null_safe(spark):
    left = spark.createDataFrame([(None, 1), (2, 2)], "a int, b int")
    right = spark.createDataFrame([(None, 1)], "a int, b int")
    assert rows(R.subtract_all_equal(left, right)) == [(2, 2)]


def test_storage_levels():
    assert R.storage_level("none") is None
    assert R.storage_level("MEMORY_AND_DISK") is not None
    with pytest.raises(ValueError):
        R.storage_level("MEMORY_SOMETIMES")


def test_stage_registers_view(spark):
    df = spark.range(10)
    R.stage(df, "staged_t", level="MEMORY_ONLY", partitions=2)
    assert spark.sql("select count(*) c from staged_t").first()["c"] == 10
    assert "staged_t" in [t.name for t in spark.catalog.listTables()]


def test_top_n_per_group_ties_by_key(spark):
    df = spark.createDataFrame([(1, 10, 5), (1, 11, 5), (1, 12, 7), (2, 1, 1)], "g int, k int, v int")
    out = R.top_n_per_group(df, ["g"], [F.col("v").desc(), F.col("k")], 2)
    assert rows(out, "g", "k", "rank") == [(1, 10, 2), (1, 12, 1), (2, 1, 1)]


def test_bucket_split(spark):
    df = spark.range(20)
    s = R.bucket_split(df, F.col("id"), {"train": (0, 6), "validation": (6, 8), "test": (8, 10)})
    counts = dict(rows(s.groupBy("split").count()))
    assert counts == {"train": 12, "validation": 4, "test": 4}


def test_global_row_number_matches_sort(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(200)], "a int, b int")
    out = R.global_row_number(df, ["a", "b"], parts=5)
    got = [(r["a"], r["b"]) for r in sorted(out.collect(), key=lambda r: r["rank"])]
    assert got == sorted((i % 7, i) for i in range(200))
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, 201))


def test_distinct_counts(spark, monkeypatch):
    """Dense, spread, negative, repeated and null ids; many slices; equal to count(distinct)."""
    monkeypatch.setattr(R, "_SLICE", 50)
    df = spark.range(0, 3000, 1, 5).select(
        (F.col("id") % 137).cast("int").alias("dense"),
        F.when(F.col("id") % 3 == 0, F.xxhash64(F.col("id") % 500)).alias("spread"),
        (F.col("id") % 130 - 64).alias("signed"), F.lit(None).cast("long").alias("none"))
    ends = spark.createDataFrame([(0, -2**63, 2**63 - 1, None), (1, 2**63 - 1, -2**63, None)], "dense int, spread long, signed long, none long")
    df = df.union(ends)
    out = R.distinct_counts(df, {f"n_{c}": c for c in df.columns}, rows="n")
    want = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(f"n_{c}") for c in df.columns])
    assert out.columns == want.columns and out.collect() == want.collect()
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(R.distinct_counts(df.filter("dense > 1000"), {"a": "dense"}, rows="n")) == [(0, 0)]
    with pytest.raises(TypeError):
        R.distinct_counts(df.withColumn("t", F.lit("x")), {"a": "t"})
