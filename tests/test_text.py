from pyspark.sql import functions as F

from support import rows
from tessera.functions.columns import java_hash_code
from tessera.sources import text as T


def lines(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "value string")


def test_java_hash_code(spark):
    df = lines(spark, ["hello", "", "Brand#13", "é", "a\U0001F600b"])
    got = dict(rows(df.select("value", java_hash_code("value").alias("h"))))

    def jh(s):
        h = 0
        for u in s.encode("utf-16-be").hex(" ", 2).split():
            h = (31 * h + int(u, 16)) & 0xFFFFFFFF
        return h - (1 << 32) if h >= 1 << 31 else h

    assert got["hello"] == 99162322
    for s in ["", "Brand#13", "é", "a\U0001F600b"]:
        assert got[s] == jh(s), s


def test_dense_vectors_reject_bad_lines(spark):
    df = T.parse_dense_vectors(lines(spark, ["", "1.5", "1 2 3", "4 x"]))
    assert [r["features"] for r in df.collect()] == [[1.0, 2.0, 3.0]]


def test_category_docs(spark):
    df = T.parse_category_docs(lines(spark, ["no separator", "a::::b::::c"]))
    assert rows(df, "category", "text") == [("a", "b::::c")]


def test_edge_list(spark):
    df = T.parse_edge_list(lines(spark, ["# comment", "3 1 7", "1 2", "1 2"]), canonical=True)
    assert rows(df) == [(1, 2), (1, 2), (1, 3)]


def test_labeled_points_roundtrip(spark):
    src = spark.createDataFrame([(1.0, 0.5, -2.0), (0.0, 1e-9, 3.25)], "y double, a double, b double")
    p = T.parse_labeled_points(T.format_labeled_points(src, "y", ["a", "b"]))
    assert rows(p) == [(0.0, [1e-9, 3.25]), (1.0, [0.5, -2.0])]


def test_delimited_double_to_long(spark):
    df = T.parse_delimited(lines(spark, ["1|12.0|x"]), [("a", "int"), ("b", "double->long"), ("c", "string")])
    assert rows(df) == [(1, 12, "x")]


def test_movielens_bucket(spark):
    df = T.parse_movielens(lines(spark, ["1::2::4.5::978300760"]))
    assert rows(df) == [(1, 2, 4.5, 0)]
