from pyspark.sql import functions as F

from support import SF_SMALL, rows
from tessera.operators import graph as G
from tessera.operators.report import PhaseTimer
from tessera.sources import text as T
from tessera.sources.tables import Tables
from tessera.streaming import pageviews as PV
from tessera.streaming.runner import head_per_batch, table_stream


def lines(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "value string")


def test_more_parsers(spark):
    assert rows(T.parse_weighted_edges(lines(spark, ["1::2::0.5"]))) == [(1, 2, 0.5)]
    assert rows(T.parse_ratings_csv(lines(spark, ["3,4,5.0"]))) == [(3, 4, 5.0)]
    assert rows(T.parse_id_names(lines(spark, ["7,Ann, B"]))) == [(7, "Ann, B")]
    assert rows(T.parse_page_views(lines(spark, ["http://a\t200\t94709\t12"]))) == [("http://a", 200, 94709, 12)]
    r = spark.createDataFrame([(1, 2, 0.0), (1, 3, 4.0)], "user int, item int, rating double")
    assert T.positive_ratings(r).count() == 1
    try:
        T.positive_ratings(r.filter("rating <= 0"))
        raise AssertionError("empty personal ratings must fail")
    except ValueError:
        pass


def test_catalog(spark):
    t = Tables(spark, SF_SMALL)
    t.register(["nation", "region"])
    assert {"nation", "region"} <= set(t.list_tables())
    assert spark.sql("select count(*) c from nation").first()["c"] == 25


def test_partition_edges_keeps_rows(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "src long, dst long")
    p = G.partition_edges(e, 3)
    assert p.rdd.getNumPartitions() == 3 and rows(p) == rows(e)


def test_marked_ratio(spark):
    df = spark.createDataFrame([(0.5,), (0.01,)], "ratio double")
    assert sorted(r[0] for r in df.select(PV.marked()).collect()) == ["**0.5000**", "0.0100"]


def test_head_per_batch(spark):
    out = head_per_batch(table_stream(spark, SF_SMALL, "events"), 10, ["event_id"])
    assert [r["event_id"] for r in out.orderBy("event_id").collect()] == list(range(10))


def test_phase_timer(spark):
    t = PhaseTimer()
    with t.phase("load"):
        spark.range(10).count()
    with t.phase("training"):
        pass
    assert t.json().startswith('{"loadTime":') and '"trainingTime":' in t.json()
    assert t.frame(spark).columns == ["load_s", "training_s"]
