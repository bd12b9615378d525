"""Machine-learning operators as DataFrame jobs.

Training loops (SGD, Lloyd's K-means) keep only the model — a weight
vector or K centres, whose size is fixed by the caller's dimension and K,
never by the data — on the driver; it enters each step's plan as an array
literal.  Every step is one distributed aggregate with map-side partial
sums, so no data row ever reaches the driver.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import literal_vectors, sigmoid, vec_sqdist
from .iterate import cut, cut_to_table, join_plain

# --------------------------------------------------------------------------
# Full-batch gradient descent (ML1-ML3)
# --------------------------------------------------------------------------

LOSSES = ("logistic", "hinge", "least_squares")


def _multiplier(kind: str, margin: Column, y: Column) -> Column:
    """Per-row scalar m with gradient = m * x."""
    if kind == "logistic":
        return sigmoid(margin) - y
    if kind == "hinge":
        ys = F.lit(2.0) * y - F.lit(1.0)
        return F.when(ys * margin < 1.0, -ys).otherwise(F.lit(0.0))
    if kind == "least_squares":
        return margin - y
    raise ValueError(kind)


def sgd(data: DataFrame, kind: str, num_iter: int, dim: int, step: float = 1.0,
        reg: float = 0.0, tol: float = 0.0, features: str = "features",
        label: str = "label", w0: list[float] | None = None) -> list[float]:
    """Gradient descent with the full batch each step: start at ``w0``
    (zeros), step size ``step / sqrt(t)``, optional L2 shrink
    ``w *= 1 - step_t * reg`` before the gradient step, optional stop when
    the weights move by less than ``tol * max(|w|, 1)``.  Returns the
    weight vector."""
    x, y = F.col(features), F.col(label).cast("double")
    w = list(w0) if w0 is not None else [0.0] * dim
    for t in range(1, num_iter + 1):
        m = _multiplier(kind, margin(w, features), y)
        row = data.agg(F.count(F.lit(1)).alias("n"),
                       *[F.sum(m * x[j]).alias(f"g{j}") for j in range(dim)]).first()
        n = row["n"]
        if not n:
            break
        g = [row[f"g{j}"] / n for j in range(dim)]
        st = step / math.sqrt(t)
        prev = w
        w = [wi * (1.0 - st * reg) - st * gi for wi, gi in zip(w, g)]
        if tol > 0:
            diff = math.sqrt(sum((a - b) ** 2 for a, b in zip(prev, w)))
            if diff < tol * max(math.sqrt(sum(v * v for v in w)), 1.0):
                break
    return w


def weights_frame(spark, w: list[float], places: int = 9) -> DataFrame:
    """Model as rows ``(j, w)`` (rounded for comparison)."""
    return spark.createDataFrame([(j, round(float(v), places) + 0.0) for j, v in enumerate(w)],
                                 "j int, w double")


def margin(w: list[float], features: str = "features") -> Column:
    """ML15: raw score x·w of a linear model, unrolled into plain column
    arithmetic (one product per weight) so it stays inside whole-stage code
    generation; summed in index order."""
    x = F.col(features)
    out = F.lit(0.0)
    for j, v in enumerate(w):
        out = out + F.lit(float(v)) * x[j]
    return out


def mse(df: DataFrame, pred: Column, label: str = "label") -> DataFrame:
    """AGG13: mean squared error."""
    return df.agg(F.avg((pred - F.col(label)) ** 2).alias("mse"))


def error_rate(df: DataFrame, pred: Column, label: str = "label") -> DataFrame:
    """AGG15: share of rows with prediction != label."""
    return df.agg(F.avg((pred != F.col(label)).cast("double")).alias("error_rate"))


# --------------------------------------------------------------------------
# Exact area under ROC (AGG16)
# --------------------------------------------------------------------------

def exact_auc(df: DataFrame, score: Column, label: Column, parts: int | None = None) -> DataFrame:
    """AUC = P(score_pos > score_neg) + P(equal)/2, exactly (ties averaged).

    Rows are first reduced to one row per distinct score with its positive
    and negative counts; the distinct scores are range-partitioned, so a
    window per range partition gives the negatives below each score there.
    Each partition becomes one row (its part of the sum, and its positives and
    negatives); the negatives in all lower partitions come from a running sum
    over these rows.  No step gathers the scores in one task.
    """
    g = (df.select(score.cast("double").alias("s"), label.cast("double").alias("y"))
         .groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1.0 - F.col("y")).alias("neg")))
    ranged = g.repartitionByRange(parts, "s") if parts else g.repartitionByRange("s")
    before = Window.partitionBy("pid").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(before), F.lit(0.0))
    per = (ranged.select(F.spark_partition_id().alias("pid"), "s", "pos", "neg").withColumn("below", below)
           .groupBy("pid").agg(F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg"))).alias("area"),
                               F.sum("pos").alias("p"), F.sum("neg").alias("n")))
    # one row per partition from here on
    lower = F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    # null, not an error, when one class is absent
    return (per.withColumn("area", F.col("area") + F.col("p") * lower)
            .agg(F.try_divide(F.sum("area"), F.sum("p") * F.sum("n")).alias("auc")))


# --------------------------------------------------------------------------
# Lloyd's K-means (ML9, AGG22)
# --------------------------------------------------------------------------

def _nearest(centres: list[list[float]], places: int):
    """Vectorised assignment: (distance, centre) of a column of points."""
    def task(col):
        import numpy as np
        import pandas as pd
        x = np.stack(col.to_numpy()) if len(col) else np.zeros((0, len(centres[0])))
        d = np.empty((len(x), len(centres)))
        for k, c in enumerate(centres):  # in index order, as a sum of squares over the dimensions
            d[:, k] = np.round(((x - np.asarray(c)) ** 2).cumsum(axis=1)[:, -1], places) if x.shape[1] else 0.0
        best = d.argmin(axis=1) if len(x) else np.zeros(0, int)
        return pd.DataFrame({"dist": d[np.arange(len(x)), best], "cluster": best.astype("int32")})

    return F.pandas_udf(task, "dist double, cluster int")


def _assign(points: DataFrame, centres: list[list[float]], features: str, places: int) -> DataFrame:
    # Arrow batches and numpy: array lambdas would run interpreted, K x dim
    # boxed steps a row
    return (points.withColumn("_n", _nearest(centres, places)(F.col(features)))
            .withColumns({"dist": F.col("_n.dist"), "cluster": F.col("_n.cluster")}).drop("_n"))


def kmeans_lloyd(points: DataFrame, init: list[list[float]], num_iter: int,
                 features: str = "features", places: int = 9) -> list[list[float]]:
    """Lloyd iterations from the given centres.  Distances are rounded to
    ``places`` decimals and ties go to the lowest centre index; a centre
    that receives no point keeps its position.  Returns the centres."""
    centres = [list(map(float, c)) for c in init]
    dim = len(centres[0])
    # the points do not change between steps (the centres travel as
    # literals), so the lineage does not grow: keep them, no checkpoint
    pts = points.select(features).persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(num_iter):
        a = _assign(pts, centres, features, places)
        rows = (a.groupBy("cluster")
                .agg(*[F.avg(F.col(features)[j]).alias(f"c{j}") for j in range(dim)])
                .collect())  # at most K rows: the model, not the data
        for r in rows:
            centres[r["cluster"]] = [float(r[f"c{j}"]) for j in range(dim)]
    pts.unpersist()
    return centres


def kmeans_assign(points: DataFrame, centres: list[list[float]], features: str = "features",
                  places: int = 9) -> DataFrame:
    return _assign(points, centres, features, places)


def wssse(points: DataFrame, centres: list[list[float]], features: str = "features") -> DataFrame:
    """AGG22: within-set sum of squared distances to the nearest centre."""
    near = points.select(_nearest(centres, 17)(F.col(features)).alias("n"))
    return near.agg(F.sum("n.dist").alias("wssse"))


# --------------------------------------------------------------------------
# Aggregates a tree level / PCA need (ML6, ML12)
# --------------------------------------------------------------------------

def split_stats(df: DataFrame, binned: dict[str, Column], label: str) -> DataFrame:
    """ML6: for every (feature, bin): rows and Gini impurity of ``label``."""
    names = list(binned)
    stacked = df.select(F.col(label).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), binned[n].cast("long").alias("bin")) for n in names
    ])).alias("fb")).select("fb.feature", "fb.bin", "y")
    c = stacked.groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("c"))
    return (c.groupBy("feature", "bin")
            .agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("ss"))
            .select("feature", "bin", "n",
                    (F.lit(1.0) - F.col("ss") / (F.col("n") * F.col("n"))).alias("gini")))


def covariance(df: DataFrame, cols: list[str]) -> DataFrame:
    """ML12: population covariance for every pair i <= j, as rows
    ``(i, j, cov)``; one aggregate pass over the data."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*[F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("cov"))
        for i, j in pairs])).alias("p")).select("p.i", "p.j", "p.cov")


# --------------------------------------------------------------------------
# Principal components by orthogonal iteration (ML11)
# --------------------------------------------------------------------------

def covariance_matrix(points: DataFrame, features: str = "features"):
    """Sample covariance of array<double> rows as a dim x dim numpy matrix (the
    model size, not the data): tasks add up sums and products of whole Arrow
    batches, and one row per matrix cell and task is summed by key."""
    import numpy as np

    def task(batches):
        import pyarrow as pa
        total = None
        for b in batches:
            col = b.column(0)
            if not b.num_rows:
                continue
            x = np.asarray(col.flatten(), dtype=float).reshape(b.num_rows, -1)
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "s"])

    cells = points.select(features).dropna().mapInArrow(task, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    dim = 1 + int(cells["i"].max()) if len(cells) else 1
    m = np.zeros((dim, dim))
    m[cells["i"], cells["j"]] = cells["s"]
    n, mean = m[0, 0], m[0, 1:] / max(m[0, 0], 1.0)
    return (m[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1.0, 1.0)


def principal_components(cov, k: int, iters: int | None = None, tol: float = 1e-12):
    """The first ``k`` principal directions of a covariance matrix, as rows, by
    orthogonal iteration: each direction is multiplied by the matrix, made
    orthogonal to those before it and scaled to 1, ``iters`` times or until it
    moves by less than ``tol``.  The start is the vector of ones; a direction's
    largest component (the first of equals) is positive."""
    import numpy as np
    dim = len(cov)
    if not 0 < k <= dim:
        raise ValueError(f"1 to {dim} components")
    found = np.zeros((0, dim))
    for c in range(k):
        def free(x):
            x = x - found.T @ (found @ x)
            x = x - found.T @ (found @ x)
            return x / np.linalg.norm(x)

        v = free(np.ones(dim) + np.arange(dim) * (c + 1) / dim)
        step = 0
        while iters is None or step < iters:
            w = cov @ v
            if np.linalg.norm(w - found.T @ (found @ w)) <= 1e-14 * max(1.0, np.abs(cov).max()):
                break  # nothing is left to explain; any free direction will do
            w, step = free(w), step + 1
            moved, v = np.abs(w - v).max(), w
            if iters is None and moved < tol:
                break
        found = np.concatenate([found, [v * (1.0 if v[np.abs(v).round(9).argmax()] > 0 else -1.0)]])
    return found


def project(points: DataFrame, directions, features: str = "features", out: str = "projected") -> DataFrame:
    """Adds the coordinates of every row along ``directions`` (not centred)."""
    import numpy as np
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
    v = np.asarray(directions)

    def task(batches):
        import pyarrow as pa
        for b in batches:
            x = np.asarray(b.column(features).flatten(), dtype=float).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, v.shape[1]))
            y = x @ v.T
            col = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * len(v)), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, col], names=[*b.schema.names, out])

    return points.mapInArrow(task, StructType([*points.schema.fields, StructField(out, ArrayType(DoubleType()))]))


# --------------------------------------------------------------------------
# TF-IDF (ML13, ML14)
# --------------------------------------------------------------------------

WHITESPACE = r"[ \t\n\r\f\x0B]+"


def term_frequencies(docs: DataFrame, doc_col: str, text_col: str,
                     pattern: str = WHITESPACE) -> DataFrame:
    """(doc, term, tf) with tokens = text split on ``pattern``, empty tokens
    dropped.  What is shuffled is each text, once, to its document's place;
    its terms are split and counted there."""
    tok = docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).repartition("doc")
    tok = tok.select("doc", F.explode(F.split("text", pattern)).alias("term"))
    return (tok.filter(F.length("term") > 0)
            .groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf")))


def tfidf(docs: DataFrame, doc_col: str, text_col: str, min_doc_freq: int = 2,
          pattern: str = WHITESPACE) -> DataFrame:
    """ML13: ``tfidf = tf * ln((m + 1) / (df + 1))``, 0 for terms in fewer
    than ``min_doc_freq`` documents; ``m`` counts every document.  Document
    frequencies are cut before they are joined, so that AQE can split the rows
    of a term that every document holds."""
    tf = cut_to_table(term_frequencies(docs, doc_col, text_col, pattern))
    m = docs.agg(F.count(F.lit(1))).scalar()
    dfreq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.when(F.col("df") >= min_doc_freq,
                 F.log((m + F.lit(1.0)) / (F.col("df") + F.lit(1.0)))).otherwise(F.lit(0.0))
    return join_plain(tf, dfreq, "term").select("doc", "term", "tf", (F.col("tf") * idf).alias("tfidf"))


def hashed_tfidf(docs: DataFrame, doc_col: str, text_col: str, num_features: int = 1 << 20,
                 min_doc_freq: int = 2, pattern: str = WHITESPACE) -> DataFrame:
    """ML13b in long (sparse) form: ``(doc, bucket, tf, tfidf)``.

    The bucket is ``hashCode(term) mod num_features`` (non-negative), the
    hashing of the original RDD-based HashingTF, computed JVM-side; rows are
    the non-zeros of the hashed vectors, so no dense 2^20 vector is built.
    """
    from ..functions.columns import java_hash_code
    tf = cut_to_table(term_frequencies(docs, doc_col, text_col, pattern))
    # each distinct term is hashed once
    terms = tf.select("term").distinct().withColumn("bucket", F.pmod(java_hash_code("term"), F.lit(num_features)))
    b = cut_to_table(join_plain(tf, terms, "term").groupBy("doc", "bucket").agg(F.sum("tf").cast("double").alias("tf")))
    m = docs.agg(F.count(F.lit(1))).scalar()
    dfreq = b.groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))
    idf = F.when(F.col("df") >= min_doc_freq,
                 F.log((m + F.lit(1.0)) / (F.col("df") + F.lit(1.0)))).otherwise(F.lit(0.0))
    return join_plain(b, dfreq, "bucket").select("doc", "bucket", "tf", (F.col("tf") * idf).alias("tfidf"))
