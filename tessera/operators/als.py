"""Alternating least squares by normal equations (ML7), its grid search (ML8)
and the scoring join (JN6), on 64-bit ids.

One half step joins the ratings with the factors of one side and sums, for every
id of the other, the outer products of those factors and their products with
the ratings; ids are then solved for in Arrow batches.  A rating is sent with its
vector to the id that is summed, where the sums run in place, whatever the number
of ratings; the joined tables are written ones, plain shuffles on both sides,
which AQE may split.  Nothing of the model passes through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import cut_to_table as cut
from .iterate import release
from .svdpp import _dot, _start


def _solve(rank: int, gram: Column, rhs: Column, ridge: Column) -> Column:
    """Solution of ``(gram + ridge * I) x = rhs`` of every row, by batches."""
    def task(g, b, lam):
        import numpy as np
        import pyarrow as pa
        kind = pa.list_(pa.float64())
        if not len(g):
            return pa.array([], kind)
        a = g.flatten().flatten().to_numpy().reshape(-1, rank, rank).copy()
        a[:, np.arange(rank), np.arange(rank)] += lam.to_numpy()[:, None]
        x = np.linalg.solve(a, b.flatten().to_numpy().reshape(-1, rank, 1))
        return pa.ListArray.from_arrays(np.arange(0, x.size + 1, rank, dtype=np.int32), x.reshape(-1))

    return F.arrow_udf(task, "array<double>")(gram, rhs, ridge)


def _half(ratings: DataFrame, factors: DataFrame, key: str, other: str, rank: int, reg: float) -> DataFrame:
    """Factors ``(key, factors)`` that fit the ratings best, given the other side's."""
    f = lambda i: F.get(F.col("factors"), i)
    # a rating moves once, with one vector: partial sums, of few ratings each, would be rank + 3 times as many numbers
    x = (ratings.join(factors, other).select(key, "rating", "factors").repartition(key)
         .withColumn("_i", F.explode(F.array(*[F.lit(i) for i in range(rank)]))))  # a row of the matrix each
    g = x.groupBy(key, "_i").agg(
        *[F.sum(f(F.col("_i")) * f(F.lit(j))).alias(f"g{j}") for j in range(rank)],
        F.sum(F.col("rating") * f(F.col("_i"))).alias("b"), F.count(F.lit(1)).alias("n"))
    rows = F.array_sort(F.collect_list(F.struct("_i", "b", "n", F.array(*[f"g{j}" for j in range(rank)]).alias("g"))))
    g = g.groupBy(key).agg(rows.alias("r"))
    return g.select(key, _solve(rank, F.col("r.g"), F.col("r.b"), F.lit(float(reg)) * F.col("r")[0]["n"]).alias("factors"))


def als_normal(ratings: DataFrame, rank: int, iters: int, reg: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Factors of users and items, ``(user, factors)`` and ``(item, factors)``,
    after ``iters`` rounds (users, then items).

    Minimises squared errors plus ``reg`` times, for each id, its number of
    ratings times its squared length (weighted lambda).  Item factors start by
    the rule of :func:`svdpp._start`, so runs repeat exactly.  Rows with a null
    in user, item or rating are left out; a repeated rating counts each time; an
    empty table gives empty factors.  ``reg`` must be positive, so that every
    system has a solution.
    """
    if reg <= 0 or rank < 1 or iters < 1:
        raise ValueError("als_normal: rank and iters of at least 1, reg above 0")
    r = cut(ratings.select(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item"),
                           F.col("rating").cast("double").alias("rating")).dropna())
    items = cut(r.select("item").distinct().select("item", _start(F.col("item"), rank, seed, 1).alias("factors")))
    users = None
    for _ in range(iters):
        before = users, items
        users = cut(_half(r, items, "user", "item", rank, reg))
        items = cut(_half(r, users, "item", "user", rank, reg))
        for old in before:
            release(old)
    release(r)
    return users, items


def score_factors(data: DataFrame, users: DataFrame, items: DataFrame, rank: int, default: float | None) -> DataFrame:
    """JN6: every row of ``data(user, item, ...)`` with its ``prediction``;
    where the user or the item has no factors (or is null) it is ``default``."""
    zero = F.array(*[F.lit(0.0)] * rank)
    d = (data.join(users.select("user", F.col("factors").alias("_u")), "user", "left")
         .join(items.select("item", F.col("factors").alias("_v")), "item", "left"))
    p = _dot(F.coalesce("_u", zero), F.coalesce("_v", zero))
    known = F.col("_u").isNotNull() & F.col("_v").isNotNull()
    return d.withColumn("prediction", F.when(known, p).otherwise(F.lit(default))).select(*data.columns, "prediction")


def _error(scored: DataFrame) -> tuple[int, float | None]:
    n, m = scored.agg(F.count("rating"), F.avg((F.col("prediction") - F.col("rating")) ** 2)).first()
    return n, None if m is None else math.sqrt(m)


def als_search(train: DataFrame, valid: DataFrame, test: DataFrame, ranks=(8, 12), regs=(0.1,), iters=(10,),
               seed: int = 0) -> DataFrame:
    """ML8: a row for every configuration with the validation error over all
    rows of that split; the best one (ties: the first) also has its test error
    and the gain in percent over predicting the mean of train and validation,
    which also stands in for unseen ids.  Without validation rows none is best."""
    mu = train.select("rating").unionByName(valid.select("rating")).agg(F.avg("rating")).first()[0]
    rows, best = [], None
    for rank in ranks:
        for reg in regs:
            for it in iters:
                users, items = als_normal(train, rank, it, reg, seed)
                n, v = _error(score_factors(valid, users, items, rank, mu))
                rows.append([rank, float(reg), it, n, v])
                model = (v, len(rows) - 1, users, items)
                if v is not None and (best is None or v < best[0]):
                    best, model = model, best
                for old in model[2:] if model else ():
                    release(old)
    out = [(*r, False, None, None, None) for r in rows]
    if best is not None:
        i = best[1]
        n, err = _error(score_factors(test, best[2], best[3], rows[i][0], mu))
        base = test.agg(F.sqrt(F.avg((F.col("rating") - F.lit(mu)) ** 2))).first()[0]
        gain = (base - err) / base * 100 if base and err is not None else None
        out[i] = (*rows[i], True, n, err, gain)
    return train.sparkSession.createDataFrame(
        out, "rank int, reg double, iters int, n_valid long, valid_rmse double, best boolean, "
             "n_test long, test_rmse double, improvement_pct double")
