"""Recommendations from factor tables (SRT6): for every user the ``n`` items
with the largest product of factors, without ever storing all pairs.

A product is at most the product of the two lengths (Cauchy-Schwarz).  Items
are dealt into blocks by falling length, each a small share of the table.  A
first pass multiplies all users with the block of the longest items; a user's
``n``-th best score there is a floor.  The second pass takes a user only to the
blocks whose longest item can still reach that floor, and returns only what
does, so what is shuffled is each user once per block left to it and a few
candidates.  Users are grouped by the blocks left to them, and every (user
block, item block) pair is one group, whose product is one matrix in one task:
memory per task is a block pair, whatever the number of users and items.  The
result is exact; only the work depends on how much the lengths differ.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import cut_to_table as cut
from .relational import top_n_per_group
from .svdpp import _dot

BLOCK = 4096  # items of the first pass
WIDE = 4  # a block of users, and one of the other items, has this many times as many rows
DIGITS = 9  # decimals of a score, so that ties are ties on any machine
SLACK = 1e-8  # more than two rounded scores differ from their products


def top_of_block(user: np.ndarray, uf: np.ndarray, item: np.ndarray, vf: np.ndarray, seen: tuple[np.ndarray, np.ndarray], n: int,
                 least: np.ndarray | None = None):
    """(user, item, score) of each user's ``n`` best items of a block, ties to
    the smaller item; ``seen`` (user, item) pairs do not count, nor do scores
    below the user's ``least`` (NaN: no such limit)."""
    order, by_user, by_seen = np.argsort(item), np.argsort(user), np.argsort(seen[0])
    item, vf = item[order], vf[order]
    seen = seen[0][by_seen], seen[1][by_seen]
    out = []
    rows = max(1, (1 << 22) // max(1, len(item)))
    for low in range(0, len(user), rows):
        mine = by_user[low:low + rows]
        score = uf[mine] @ vf.T
        near = slice(np.searchsorted(seen[0], user[mine[0]]), np.searchsorted(seen[0], user[mine[-1]], "right"))
        su, si = seen[0][near], seen[1][near]
        at = np.flatnonzero(np.isin(su, user[mine]) & np.isin(si, item))
        score[np.searchsorted(user[mine], su[at]), np.searchsorted(item, si[at])] = -np.inf
        floor = np.full(len(mine), np.nan) if least is None else least[mine]
        free = np.isnan(floor)
        floor[free] = np.partition(score[free], len(item) - n, axis=1)[:, len(item) - n] if n < len(item) else -np.inf
        r, c = np.nonzero((score >= floor[:, None] - SLACK) & (score > -np.inf))
        s = np.round(score[r, c], DIGITS) + 0.0
        o = np.lexsort((c, -s, r))
        r, c, s = r[o], c[o], s[o]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = place < n
        out.append((user[mine][r[keep]], item[c[keep]], s[keep]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (user[:0], item[:0], np.zeros(0))


def _pick(key: Column, values: dict[int, int]) -> Column:
    """The value of a small whole number, null for one without."""
    return F.get(F.array(*[F.lit(values.get(k)).cast("long") for k in range(max(values, default=0) + 1)]), key.cast("int"))


def _products(left: DataFrame, right: DataFrame, n: int) -> DataFrame:
    """Lists of every (ub, ib) group: ``left`` has users (``item`` null) and
    rated pairs (``factors`` null), ``right`` items."""
    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        is_user = a.column("item").is_null()
        people, pairs = a.filter(is_user), a.filter(a.column("item").is_valid())
        matrix = lambda t: np.array(t.column("factors").combine_chunks().flatten()).reshape(t.num_rows, -1)
        if not people.num_rows or not b.num_rows:
            u, i, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            u, i, s = top_of_block(people.column("user").to_numpy(), matrix(people), b.column("item").to_numpy(), matrix(b),
                                   (pairs.column("user").to_numpy(), pairs.column("item").to_numpy()), n,
                                   people.column("least").to_numpy().astype(float))
        return pa.table({"user": u, "item": i, "score": s})

    return left.groupBy("ub", "ib").cogroup(right.groupBy("ub", "ib")).applyInArrow(product, "user long, item long, score double")


def recommend(users: DataFrame, items: DataFrame, n: int, rated: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``(user, item, score, rank)``: each user's ``n`` best items.

    ``users`` is (user, factors), ``items`` (item, factors), ids longs, factors
    arrays of double; ``rated`` (user, item) pairs are left out, as a user's
    own ratings are.  Scores are rounded to 9 decimals; ties go to the smaller
    item.  Ids are unique in their table; null ids and null or NaN factors take
    no part; a user all of whose items are rated has no row."""
    def read(d: DataFrame, key: str) -> DataFrame:
        d = d.select(F.col(key).cast("long").alias(key), F.col("factors").cast("array<double>").alias("factors")).dropna()
        return cut(d.withColumn("length", F.sqrt(_dot(F.col("factors"), F.col("factors")))).filter(~F.isnan("length")))

    users, items = read(users, "user"), read(items, "item")
    own = None if rated is None else rated.select(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item")).dropna()
    nobody = F.lit(None).cast("array<double>").alias("factors")
    wide = WIDE * block
    pieces = lambda key, k: F.pmod(F.xxhash64(key), k).cast("int")
    run = lambda low, high: F.explode(F.when(high > low, F.sequence(low, high - 1)))

    # bands of items by falling length, the first of `block` items, each next one doubling what
    # lies before it; a band's blocks are numbered after those of the bands before it
    total = items.count()
    shares, size = [], block
    while size < total:
        shares.append(1 - size / total)
        size *= 2
    limits = items.agg(F.percentile_approx("length", shares, 100_000)).first()[0] if shares else []
    band = sum((F.when(F.col("length") < F.lit(x), 1).otherwise(0) for x in sorted(set(limits), reverse=True)), F.lit(0))
    bands = items.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("c"), F.max("length").alias("top")).sort("band").collect()
    starts, blocks, ends, k = {}, {}, [], 0
    for x in bands:
        starts[x["band"]], blocks[x["band"]] = k, max(1, -(-x["c"] // wide))
        k += blocks[x["band"]]
        ends.append(k)
    items = cut(items.withColumn("band", band).select(
        "item", "factors", "band", (_pick(F.col("band"), starts) + pieces("item", _pick(F.col("band"), blocks))).cast("int").alias("ib")))

    # first pass: all users and the block of the longest items
    some = max(1, -(-users.count() // wide))
    first = items.filter("ib = 0")
    none = F.lit(None)
    left = users.select(pieces("user", F.lit(some)).alias("ub"), F.lit(0).alias("ib"), "user", none.cast("long").alias("item"), "factors",
                        none.cast("double").alias("least"))
    if own is not None:
        left = left.unionByName(own.join(first.select("item"), "item").select(
            pieces("user", F.lit(some)).alias("ub"), F.lit(0).alias("ib"), "user", "item", nobody, none.cast("double").alias("least")))
    right = first.select("item", "factors", F.lit(0).alias("ib"), run(F.lit(0), F.lit(some)).alias("ub"))
    best = cut(_products(left, right, n))
    if k < 2:
        return top_n_per_group(best, ["user"], [F.col("score").desc(), F.col("item")], n)

    # second pass: the other blocks, as far as their longest item can reach the user's floor
    floor = cut(best.groupBy("user").agg(F.when(F.count(F.lit(1)) >= n, F.min("score")).alias("least")))
    reach = lambda x: F.col("length") * F.lit(x["top"]) * (1 + 1e-9) + F.lit(SLACK) >= F.col("least")
    need = sum((F.when(F.col("least").isNull() | reach(x), 1).otherwise(0) for x in bands), F.lit(0))
    open_ = cut(users.join(floor, "user", "left").withColumn("last", _pick(need, dict(enumerate([0, *ends])))).filter("last > 1"))
    # user blocks: those with most blocks left come first, so that a block of items goes to the first ones only
    firsts, counts, upto, j = {}, {}, {}, 0
    sizes = {x["last"]: x["c"] for x in open_.groupBy("last").agg(F.count(F.lit(1)).alias("c")).collect()}
    for i in range(len(ends))[::-1]:
        if ends[i] in sizes:
            firsts[i], counts[i] = j, max(1, -(-sizes[ends[i]] // wide))
            j += counts[i]
        upto[i] = j
    at = sum((F.when(F.col("last") > F.lit(x), 1).otherwise(0) for x in ends), F.lit(0))
    open_ = open_.withColumn("ub", (_pick(at, firsts) + pieces("user", _pick(at, counts))).cast("int"))
    left = open_.select("ub", run(F.lit(1), F.col("last").cast("int")).alias("ib"), "user", none.cast("long").alias("item"), "factors", "least")
    rest = items.filter("ib > 0")
    if own is not None:
        pairs = (own.join(cut(rest.select("item", "ib")), "item").join(cut(open_.select("user", "ub", "last")), "user").filter("ib < last"))
        left = left.unionByName(pairs.select("ub", "ib", "user", "item", nobody, none.cast("double").alias("least")))
    right = rest.select("item", "factors", "ib", run(F.lit(0), _pick(F.col("band"), upto).cast("int")).alias("ub"))
    lists = best.unionByName(_products(left, right, n))
    return top_n_per_group(lists, ["user"], [F.col("score").desc(), F.col("item")], n)
