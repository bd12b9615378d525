import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from support import rows
from tessera.operators import learn as L
from tessera.operators import models as M


def test_kmeans_identical_centres(spark):
    pts = spark.createDataFrame([([0.0, 0.0],), ([1.0, 0.0],), ([10.0, 10.0],)], "features array<double>")
    c = L.kmeans_lloyd(pts, [[0.0, 0.0], [0.0, 0.0], [9.0, 9.0]], 1)
    # ties go to index 0, so centre 1 receives nothing and keeps its value
    assert c[0] == [0.5, 0.0] and c[1] == [0.0, 0.0] and c[2] == [10.0, 10.0]


def test_kmeans_matches_numpy(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(120, 3))
    pts = spark.createDataFrame([(x.tolist(),) for x in X], "features array<double>")
    init = X[:4].tolist()
    got = L.kmeans_lloyd(pts, init, 4)
    C = np.array(init)
    for _ in range(4):
        d = ((X[:, None, :] - C[None]) ** 2).sum(-1).round(9)
        a = d.argmin(1)
        C = np.array([X[a == k].mean(0) if (a == k).any() else C[k] for k in range(4)])
    assert np.allclose(np.array(got), C)
    w = L.wssse(pts, got).first()[0]
    assert w == pytest.approx(((X[:, None, :] - C[None]) ** 2).sum(-1).min(1).sum())


def _auc_brute(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_all_equal(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (1.0, 1.0), (1.0, 0.0)], "s double, y double")
    assert L.exact_auc(df, F.col("s"), F.col("y")).first()[0] == pytest.approx(0.5)


def test_auc_brute_force(spark):
    rng = random.Random(4)
    data = [(float(rng.randrange(20)), float(rng.random() < 0.4)) for _ in range(300)]
    df = spark.createDataFrame(data, "s double, y double")
    got = L.exact_auc(df, F.col("s"), F.col("y"), parts=7).first()[0]
    assert got == pytest.approx(_auc_brute([d[0] for d in data], [d[1] for d in data]))


@pytest.mark.parametrize("kind,reg", [("logistic", 0.0), ("hinge", 0.01), ("least_squares", 0.0)])
def test_sgd_matches_numpy(spark, kind, reg):
    rng = np.random.default_rng(2)
    X = np.c_[np.ones(200), rng.normal(size=(200, 2))]
    y = (X @ np.array([0.2, 1.0, -1.0]) + rng.normal(scale=0.3, size=200) > 0).astype(float)
    df = spark.createDataFrame([(float(b), x.tolist()) for b, x in zip(y, X)], "label double, features array<double>")
    got = L.sgd(df, kind, 3, 3, reg=reg)
    w = np.zeros(3)
    for t in range(1, 4):
        m = X @ w
        if kind == "logistic":
            g = ((1 / (1 + np.exp(-m)) - y)[:, None] * X).mean(0)
        elif kind == "hinge":
            ys = 2 * y - 1
            g = (np.where(ys * m < 1, -ys, 0.0)[:, None] * X).mean(0)
        else:
            g = ((m - y)[:, None] * X).mean(0)
        st = 1 / math.sqrt(t)
        w = w * (1 - st * reg) - st * g
    assert np.allclose(got, w)


def test_covariance_matches_numpy(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(100, 3))
    df = spark.createDataFrame([tuple(map(float, x)) for x in X], "a double, b double, c double")
    cov = {(r["i"], r["j"]): r["cov"] for r in L.covariance(df, ["a", "b", "c"]).collect()}
    ref = np.cov(X.T, bias=True)
    for (i, j), v in cov.items():
        assert v == pytest.approx(ref[i, j])


def test_tfidf_rules(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "  ")], "id long, text string")
    got = {(r["doc"], r["term"]): (r["tf"], r["tfidf"]) for r in L.tfidf(docs, "id", "text").collect()}
    assert got[(1, "b")] == (2, 0.0)              # df = 1 < 2
    assert got[(1, "a")][1] == pytest.approx(math.log(4 / 3))


def test_hashed_tfidf_brute_force(spark):
    texts = {1: "a b b c", 2: "a c d", 3: "b e", 4: "x"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    n = 4

    def jh(s):
        h = 0
        for ch in s:
            h = (31 * h + ord(ch)) & 0xFFFFFFFF
        return h - (1 << 32) if h >= 1 << 31 else h

    tf = {}
    for d, t in texts.items():
        for w in t.split():
            k = (d, jh(w) % n)
            tf[k] = tf.get(k, 0) + 1
    df = {}
    for (d, b) in tf:
        df[b] = df.get(b, 0) + 1
    want = {k: v * (math.log(5 / (df[k[1]] + 1)) if df[k[1]] >= 2 else 0.0) for k, v in tf.items()}
    got = {(r["doc"], r["bucket"]): r["tfidf"] for r in L.hashed_tfidf(docs, "id", "text", num_features=n).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_split_stats_gini(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "x int, y string")
    s = {r["bin"]: (r["n"], r["gini"]) for r in L.split_stats(df, {"x": F.col("x")}, "y").collect()}
    assert s[1] == (2, pytest.approx(0.5)) and s[2] == (2, pytest.approx(0.0))


def test_tree_and_pca_run(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(80, 4))
    y = (X[:, 0] > 0).astype(float)
    df = spark.createDataFrame([(float(b), x.tolist()) for b, x in zip(y, X)], "label double, features array<double>")
    _, err = M.tree_classifier(df, depth=3, bins=16)
    assert err.first()["training_error"] < 0.1
    _, proj = M.pca_project(df, 2)
    assert len(proj.first()["projected"]) == 2


def test_dense_ids(spark):
    df = spark.createDataFrame([(5_000_000_000, 1.0), (7, 2.0), (5_000_000_000, 3.0)], "user long, rating double")
    d = M.dense_ids(df, "user")
    got = sorted((r["user_id"], r["user"]) for r in d.collect())
    assert got == [(7, 0), (5_000_000_000, 1), (5_000_000_000, 1)]
    small = M.dense_ids(spark.createDataFrame([(3, 1.0)], "user long, rating double"), "user")
    assert small.schema["user"].dataType.simpleString() == "int" and small.columns == d.columns


def test_auc_one_class_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "s double, y double")
    assert L.exact_auc(df, F.col("s"), F.col("y")).first()[0] is None


def test_principal_components_equal_eigenvectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6)) @ rng.normal(size=(6, 6)) + 3.0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>").repartition(3)
    cov = L.covariance_matrix(df)
    assert np.allclose(cov, np.cov(x.T))
    v = L.principal_components(cov, 6)
    assert np.abs(v @ v.T - np.eye(6)).max() < 1e-6
    values, vectors = np.linalg.eigh(np.cov(x.T))
    for row, want in zip(v, vectors.T[::-1]):
        assert min(np.abs(row - want).max(), np.abs(row + want).max()) < 1e-5 and row[np.abs(row).argmax()] > 0
    got = {r.id: r.projected for r in L.project(df, v[:2]).collect()}
    assert all(np.allclose(got[i], v[:2] @ x[i]) for i in range(500))
    from tessera.operators.models import pca_project
    theirs = {r.id: r.projected for r in pca_project(df, 2)[1].collect()}
    assert all(np.allclose(np.abs(got[i]), np.abs(theirs[i]), atol=1e-4) for i in range(500))
    flat = L.principal_components(np.zeros((3, 3)), 3)
    assert np.abs(flat @ flat.T - np.eye(3)).max() < 1e-6
    with pytest.raises(ValueError):
        L.principal_components(cov, 7)


def test_texts_move_once_and_terms_are_counted_there(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "a  c"), (None, "b"), (2, None)], "id long, text string")
    tf = L.term_frequencies(docs, "id", "text")
    assert sorted(map(tuple, tf.collect()), key=str) == sorted([(1, "a", 3), (1, "b", 1), (1, "c", 1), (None, "b", 1)], key=str)
    assert tf._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
