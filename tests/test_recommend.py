import numpy as np
import pytest
from pyspark.sql import functions as F

from support import shuffle_files
from tessera.operators import models as M
from tessera.operators.recommend import DIGITS, recommend


def brute(users, items, n, rated=()):
    out = []
    for u, f in users:
        scores = [(-round(float(np.dot(f, g)), DIGITS) + 0.0, i) for i, g in items if (u, i) not in rated]
        out += [(u, i, -s + 0.0, k + 1) for k, (s, i) in enumerate(sorted(scores)[:n])]
    return sorted(out)


def got(df):
    return sorted((r.user, r.item, r.score, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_blocks_give_the_same_lists(spark, block):
    rng = np.random.default_rng(block)
    users = [(int(u), [float(x) for x in rng.integers(-3, 4, 3)]) for u in rng.permutation(20)]
    items = [(int(i), [float(x) for x in rng.integers(-3, 4, 3)]) for i in rng.permutation(31)]  # many ties
    rated = {(int(u), int(i)) for u, i in zip(rng.integers(0, 22, 90), rng.integers(0, 33, 90))} | {(5, i) for i in range(31)}
    udf = spark.createDataFrame(users + [(None, [1.0, 1.0, 1.0]), (77, None)], "user long, factors array<double>")
    idf = spark.createDataFrame(items + [(None, [1.0, 1.0, 1.0])], "item long, factors array<double>")
    rdf = spark.createDataFrame([*rated, (None, 1), (3, None)], "user long, item long")
    for n in (1, 4, 50):
        assert got(recommend(udf, idf, n, rdf, block)) == brute(users, items, n, rated)
        assert got(recommend(udf, idf, n, None, block)) == brute(users, items, n)
    assert not any(r[0] == 5 for r in got(recommend(udf, idf, 4, rdf, block)))


def test_trained_factors(spark):
    """The factors of a trained ALS model give its own predictions' order."""
    rng = np.random.default_rng(1)
    data = [(int(u), int(i), float(rng.integers(1, 6))) for u in range(15) for i in rng.choice(25, 8, replace=False)]
    m = M.als(spark.createDataFrame(data, "user int, item int, rating double"), rank=4, iters=3)
    users = m.userFactors.select(F.col("id").alias("user"), F.col("features").alias("factors"))
    items = m.itemFactors.select(F.col("id").alias("item"), F.col("features").alias("factors"))
    pairs = lambda d: [(r[0], [float(x) for x in r[1]]) for r in d.collect()]
    out = got(recommend(users, items, 5, block=4))
    assert out == brute(pairs(users), pairs(items), 5)
    own = {(r.user, x.item): x.rating for r in m.recommendForAllUsers(5).collect() for x in r.recommendations}
    assert all(abs(own[u, i] - s) < 1e-4 for u, i, s, _ in out if (u, i) in own)


def test_empty_sides(spark):
    u = spark.createDataFrame([(1, [1.0])], "user long, factors array<double>")
    i = spark.createDataFrame([], "item long, factors array<double>")
    assert recommend(u, i, 3).collect() == []


def test_users_go_only_to_blocks_that_can_reach_their_floor(spark, monkeypatch):
    """Far fewer copies of users than users times blocks, and the same lists."""
    from tessera.operators import recommend as R
    rng = np.random.default_rng(3)
    users = [(u, [float(x) for x in rng.normal(size=3)]) for u in range(60)]
    items = [(i, [float(x) for x in rng.normal(size=3) * rng.exponential()]) for i in range(900)]
    rated = {(int(u), int(i)) for u, i in zip(rng.integers(0, 60, 400), rng.integers(0, 900, 400))}
    copies, whole = [], R._products
    monkeypatch.setattr(R, "_products", lambda left, right, n: copies.append(left.filter("item is null").count()) or whole(left, right, n))
    sides = (spark.createDataFrame(users, "user long, factors array<double>"), spark.createDataFrame(items, "item long, factors array<double>"))
    assert got(recommend(*sides, 3, spark.createDataFrame([*rated], "user long, item long"), 16)) == brute(users, items, 3, rated)
    assert copies[0] == 60 and sum(copies) < 60 * 900 / (16 * R.WIDE) / 2


def test_scores_join_each_rating_once(spark):
    """Repeated pairs keep their rows, unseen ones get the default; no pass over distinct pairs."""
    data = [(u, i, float(u + i)) for u in range(4) for i in range(3)]
    m = M.als(spark.createDataFrame(data, "user int, item int, rating double"), rank=2, iters=1)
    d = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (9, 1, 3.0), (None, 1, 4.0)], "user int, item int, rating double")
    s = M.score(m, d, -1.0)
    out = sorted((r.user, r.item, r.rating, r.prediction == -1.0) for r in s.collect())
    assert out == [(0, 0, 1.0, False), (0, 0, 2.0, False), (9, 1, 3.0, True)]
    assert "Aggregate" not in s._jdf.queryExecution().optimizedPlan().toString()


def _some_ratings(spark):
    rng = np.random.default_rng(4)
    data = [(int(u), int(i), float(rng.integers(1, 6))) for u in range(30) for i in rng.choice(25, 5, replace=False)]
    return spark.createDataFrame(data, "user int, item int, rating double").repartition(3, "user").sortWithinPartitions("user", "item")


def test_blocks_grow_with_the_ratings(spark, monkeypatch):
    """150 ratings at 10 a block make 15 blocks; few ratings leave Spark's own 10."""
    r = _some_ratings(spark)
    few = M.als(r, rank=2, iters=1)
    assert few.userFactors.rdd.getNumPartitions() == few.itemFactors.rdd.getNumPartitions() == 10
    monkeypatch.setattr(M, "_BLOCK_RATINGS", 10, raising=False)
    many = M.als(r, rank=2, iters=3, reg=0.01)
    assert many.userFactors.rdd.getNumPartitions() == many.itemFactors.rdd.getNumPartitions() == 15
    assert many.userFactors.count() == 30 and many.itemFactors.count() == r.select("item").distinct().count()


def test_rounds_leave_no_shuffles(spark):
    """Eight rounds of ALS leave no more shuffle files than two."""
    import time
    r, left, models = _some_ratings(spark), [], []
    for iters in (2, 8):
        before = shuffle_files(spark)
        models.append(M.als(r, rank=2, iters=iters, reg=0.1))  # kept, and with it what it still needs
        for _ in range(30):
            time.sleep(0.1)
            n = len(shuffle_files(spark) - before)
            if left and n <= left[0]:
                break
        left.append(n)
    assert left[1] <= left[0]
