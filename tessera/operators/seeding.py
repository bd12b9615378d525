"""K-means|| seeding (ML10; Bahmani et al., VLDB 2012) with a hash as its
random draw, so that a seed gives the same centres on every partitioning.

Each round draws every point independently, with a chance proportional to its
squared distance from the candidates so far: one pass over the points, and only
the drawn points (``oversample`` of them in expectation) come to the driver.
They are model state, about ``oversample * rounds`` vectors however many points
there are.  Candidates are then weighted by the points nearest to them and
clustered by weighted k-means++.
"""

from __future__ import annotations

import hashlib

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import rounds as numbered
from .learn import _assign

_DIGITS = 12  # hex digits of the hash that make a draw


def draw(seed: int, step: int, key: Column) -> Column:
    """A uniform number in [0, 1) from the MD5 of ``seed:step:key``."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(str(step)), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16 ** _DIGITS))


def _pick(seed: int, step: int) -> float:
    text = f"{seed}:pick:{step}".encode()
    return int(hashlib.md5(text).hexdigest()[:_DIGITS], 16) / 16 ** _DIGITS


def candidates(points: DataFrame, k: int, oversample: float, rounds: int, seed: int, key: str,
               features: str = "features", places: int = 9) -> list[tuple[object, list[float], int]]:
    """Candidate centres ``(key, point, weight)`` in order of their keys; the
    weight is the number of points whose nearest candidate it is (ties to the
    smaller key).

    ``key`` names the points uniquely.  Rows with a null key or point are left
    out.  Distances are rounded to ``places`` decimals and summed as decimals,
    so sums do not depend on the order of rows.  After ``rounds`` rounds, more
    follow only while there are fewer than k candidates and some point is not
    one; fewer than k different points give that many candidates.
    """
    pts = points.select(F.col(key).alias("key"), F.col(features).alias("x")).dropna()
    pts = pts.persist(StorageLevel.MEMORY_AND_DISK)
    first = pts.orderBy(draw(seed, 0, F.col("key")), "key").limit(1).collect()
    found = {r["key"]: list(r["x"]) for r in first}

    def nearest() -> DataFrame:
        order = sorted(found)
        return _assign(pts, [found[c] for c in order], "x", places)

    for i in numbered(None, "k-means|| candidates"):
        if not found or (i >= rounds and len(found) >= k):
            break
        near = nearest().select("key", "dist").persist(StorageLevel.MEMORY_AND_DISK)
        phi = float(near.agg(F.sum(F.col("dist").cast("decimal(28,9)"))).first()[0])
        chance = F.lit(float(oversample)) * F.col("dist") / F.lit(phi)
        drawn = [] if phi == 0 else [r["key"] for r in near.filter(draw(seed, i + 1, F.col("key")) < chance)
                                     .select("key").collect()]
        near.unpersist()
        if drawn:
            found.update((r["key"], list(r["x"])) for r in pts.filter(F.col("key").isin(drawn)).collect())
        if phi == 0:
            break
    order = sorted(found)
    weights = {r["cluster"]: r["n"] for r in nearest().groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()} if found else {}
    pts.unpersist()
    return [(c, found[c], weights.get(j, 0)) for j, c in enumerate(order)]


def weighted_plus_plus(cands: list[tuple[object, list[float], int]], k: int, seed: int,
                       places: int = 9) -> list[list[float]]:
    """Weighted k-means++ over the candidates: each centre is drawn with a
    chance proportional to weight times squared distance from those before (the
    first: to weight), by one running sum in order of keys.  Ends early where
    all candidates coincide with centres."""
    import numpy as np
    if not cands:
        return []
    x = np.array([c[1] for c in cands], dtype=float)
    w = np.array([c[2] for c in cands], dtype=float)
    mass, least, out = w, None, []
    for step in range(k):
        run = mass.cumsum()
        if run[-1] <= 0:
            break
        j = int(np.searchsorted(run, _pick(seed, step) * run[-1], side="right"))
        out.append(x[j].tolist())
        d = np.round(((x - x[j]) ** 2).cumsum(axis=1)[:, -1], places)
        least = d if least is None else np.minimum(least, d)
        mass = w * least
    return out


def kmeans_parallel_init(points: DataFrame, k: int, key: str, oversample: float | None = None,
                         rounds: int = 5, seed: int = 127, features: str = "features") -> list[list[float]]:
    """K initial centres (fewer where there are fewer different points); two
    points a centre and round are drawn by default."""
    c = candidates(points, k, 2.0 * k if oversample is None else oversample, rounds, seed, key, features)
    return weighted_plus_plus(c, k, seed)
