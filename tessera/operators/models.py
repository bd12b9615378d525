"""Model training through Spark ML estimators (distributed trainers):
decision trees (ML4/ML5), ALS and its grid search (ML7/ML8), K-means||
(ML10) and PCA (ML11).  Each returns DataFrames —
metrics as one-row tables, predictions as columns."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_root
from .iterate import shuffles_dropped


def _vec(df: DataFrame, features: str = "features") -> DataFrame:
    return df.withColumn("fv", array_to_vector(F.col(features)))


def tree_classifier(df: DataFrame, depth: int = 5, bins: int = 100,
                    impurity: str = "gini", seed: int = 1) -> tuple[object, DataFrame]:
    """ML4: decision tree classifier on ``label, features array``; returns the
    model and the training error (share of rows predicted wrong)."""
    d = _vec(df)
    m = DecisionTreeClassifier(featuresCol="fv", labelCol="label", maxDepth=depth, maxBins=bins,
                               impurity=impurity, seed=seed).fit(d)
    pred = m.transform(d)
    err = pred.agg(F.avg((F.col("prediction") != F.col("label")).cast("double")).alias("training_error"),
                   F.lit(m.depth).alias("depth"), F.lit(m.numNodes).alias("nodes"),
                   F.lit(m.numClasses).alias("num_classes"))
    return m, err


def tree_regressor(df: DataFrame, depth: int = 5, bins: int = 100, seed: int = 1):
    """ML5: regression tree (variance impurity); returns the model and
    training RMSE plus the reference's "error" (share of predictions not
    exactly equal to the label)."""
    d = _vec(df)
    m = DecisionTreeRegressor(featuresCol="fv", labelCol="label", maxDepth=depth, maxBins=bins,
                              seed=seed).fit(d)
    pred = m.transform(d)
    out = pred.agg(F.sqrt(F.avg((F.col("prediction") - F.col("label")) ** 2)).alias("rmse"),
                   F.avg((F.col("prediction") != F.col("label")).cast("double")).alias("inequality_rate"),
                   F.lit(m.depth).alias("depth"))
    return m, out


def dense_ids(ratings: DataFrame, col: str) -> DataFrame:
    """Map a 64-bit id column onto 0..n-1 ints (ALS keeps ids as ints).

    The distinct ids get their rank in a distributed global sort and are
    joined back; the original id is kept in ``<col>_id``.  The schema is the
    same whatever the ids are."""
    from .relational import global_row_number
    ids = global_row_number(ratings.select(col).distinct(), [col], name="_ix")
    return (ratings.join(ids, col).withColumnRenamed(col, f"{col}_id")
            .withColumn(col, (F.col("_ix") - 1).cast("int")).drop("_ix"))


_BLOCK_RATINGS = 4_000_000  # ratings of a block of users or items: what bounds the memory of a task


def als(ratings: DataFrame, rank: int = 10, iters: int = 3, reg: float = 0.01, seed: int = 7,
        implicit: bool = False):
    """ML7: ALS factorisation of ``(user, item, rating)`` (int ids, see
    :func:`dense_ids`).  Unknown users and items score NaN, see :func:`score`.

    There are as many blocks as bound the ratings of one (10, Spark's number, at
    least).  Factors are checkpointed every round, upon which Spark deletes what
    the round shuffled."""
    checkpoint_root(ratings.sparkSession)
    blocks = max(10, -(-ratings.count() // _BLOCK_RATINGS))
    est = ALS(rank=rank, maxIter=iters, regParam=reg, userCol="user", itemCol="item",
              ratingCol="rating", seed=seed, coldStartStrategy="nan", implicitPrefs=implicit,
              numUserBlocks=blocks, numItemBlocks=blocks, checkpointInterval=1)
    return est.fit(ratings)


def score(model, data: DataFrame, default: float) -> DataFrame:
    """JN6: every row of ``data`` with the prediction for its (user, item): it
    is joined with the factors of both, which are unique by id, and is neither
    reduced to distinct pairs nor joined with them again; a pair that the model
    cannot score (an unseen user or item) gets ``default``, so every row with
    both ids is scored."""
    p = model.transform(data.dropna(subset=["user", "item"]))
    return (p.withColumn("prediction", F.when(F.isnan("prediction"), F.lit(default)).otherwise(F.col("prediction"))))


def rmse(model, data: DataFrame, default: float) -> float | None:
    with shuffles_dropped(data.sparkSession):
        v = score(model, data, default).agg(F.avg((F.col("prediction") - F.col("rating")) ** 2)).first()[0]
    return None if v is None else math.sqrt(v)


def als_grid(train: DataFrame, valid: DataFrame, test: DataFrame, ranks=(8, 12), regs=(0.1,),
             iters=(10,), seed: int = 7) -> DataFrame:
    """ML8: train every (rank, lambda, iterations) on the train split, score
    the validation split, keep the best; report its test RMSE and the gain
    over predicting the mean of train and validation.  All errors are over all
    rows of their split.  One row per configuration."""
    spark = train.sparkSession
    mu = train.select("rating").unionByName(valid.select("rating")).agg(F.avg("rating")).first()[0]
    rows = []
    best = None
    for r in ranks:
        for lam in regs:
            for it in iters:
                m = als(train, r, it, lam, seed)
                v = rmse(m, valid, mu)
                rows.append([r, lam, it, v])
                if v is not None and (best is None or v < best[0]):
                    best = (v, m, len(rows) - 1)
    base = test.agg(F.sqrt(F.avg((F.col("rating") - F.lit(mu)) ** 2))).first()[0]
    test_rmse = rmse(best[1], test, mu) if best else None
    out = []
    for i, (r, lam, it, v) in enumerate(rows):
        is_best = best is not None and i == best[2]
        gain = (base - test_rmse) / base * 100 if (is_best and base and test_rmse is not None) else None
        out.append((r, float(lam), it, v, is_best, test_rmse if is_best else None, gain))
    return spark.createDataFrame(out, "rank int, reg double, iters int, valid_rmse double, best boolean, "
                                      "test_rmse double, improvement_pct double")


def kmeans_parallel(points: DataFrame, k: int = 10, iters: int = 5, seed: int = 127):
    """ML10: K-means with k-means|| initialisation; returns the model, the
    assignments and the within-set sum of squared errors."""
    d = _vec(points)
    m = KMeans(k=k, maxIter=iters, seed=seed, initMode="k-means||", featuresCol="fv").fit(d)
    assigned = m.transform(d).select(*[c for c in points.columns], F.col("prediction").alias("cluster"))
    cost = points.sparkSession.createDataFrame([(float(m.summary.trainingCost),)], "wssse double")
    return m, assigned, cost


def pca_project(points: DataFrame, k: int):
    """ML11: fit PCA with k components and project every row."""
    d = _vec(points)
    m = PCA(k=k, inputCol="fv", outputCol="pv").fit(d)
    return m, m.transform(d).select(*points.columns, vector_to_array("pv").alias("projected"))
