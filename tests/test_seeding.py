import numpy as np

from tessera.operators import seeding as S

SCHEMA = "id long, features array<double>"


def _blobs(spark, n=300):
    rng = np.random.default_rng(5)
    at = np.array([[0.0, 0.0], [50.0, 0.0], [0.0, 50.0], [50.0, 50.0]])
    x = at[np.arange(n) % 4] + rng.normal(size=(n, 2))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)


def test_every_blob_gets_a_centre(spark):
    x, pts = _blobs(spark)
    c = np.array(S.kmeans_parallel_init(pts, 4, "id", seed=3))
    assert sorted((c > 25).dot([1, 2]).tolist()) == [0, 1, 2, 3]


def test_candidates_match_a_scalar_run(spark):
    x, pts = _blobs(spark, 60)
    got = S.candidates(pts, 4, 8.0, 3, 7, "id")
    draw = {(i, s): r["u"] for s in range(4)
            for i, r in enumerate(pts.orderBy("id").select(S.draw(7, s, pts.id).alias("u")).collect())}
    chosen = {min(range(60), key=lambda i: (draw[i, 0], i))}
    dist = lambda i: min(round(float(((x[i] - x[j]) ** 2).sum()), 9) for j in chosen)
    for s in range(1, 4):
        d = [dist(i) for i in range(60)]
        chosen |= {i for i in range(60) if draw[i, s] < 8.0 * d[i] / sum(d)}
    assert [c[0] for c in got] == sorted(chosen)
    near = [min(sorted(chosen), key=lambda j: (round(float(((x[i] - x[j]) ** 2).sum()), 9), j)) for i in range(60)]
    assert [c[2] for c in got] == [near.count(c[0]) for c in got]


def test_partitioning_does_not_matter(spark):
    _, pts = _blobs(spark, 80)
    assert S.kmeans_parallel_init(pts.repartition(7), 4, "id") == S.kmeans_parallel_init(pts.coalesce(1), 4, "id")


def test_fewer_different_points_than_centres(spark):
    pts = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(20)], SCHEMA)
    assert sorted(S.kmeans_parallel_init(pts, 5, "id")) == [[0.0, 0.0], [1.0, 0.0]]


def test_empty_and_null_points(spark):
    assert S.kmeans_parallel_init(spark.createDataFrame([], SCHEMA), 3, "id") == []
    pts = spark.createDataFrame([(1, [2.0]), (2, None), (None, [9.0])], SCHEMA)
    assert S.kmeans_parallel_init(pts, 3, "id") == [[2.0]]
