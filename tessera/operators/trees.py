"""Decision trees grown level by level (ML4, ML5).

Features are cut into bins once, at thresholds that the caller gives (equal
widths between each feature's extremes by default).  For each level one pass
over the data adds up a histogram (node, feature, bin) of the label's
statistics: tasks route their rows through the tree grown so far and combine
whole Arrow batches, so what is shuffled is at most nodes x features x bins rows
a task.  The best split of every node is found by window functions over the
summed histogram; only the splits, at most one a node, come to the driver, and
become the next pass's routing.  No row is written or moved between levels.

Impurity is Gini for classes and variance for numbers; a split's gain is the
share of its node's impurity that it removes.  A node is split where the gain
passes ``LEAST``; equal gains go to the first feature, then the lowest bin; a
leaf predicts the most frequent class (the
smallest of equals) or the mean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 32
LEAST = 1e-9  # gain that a split must exceed
PLACES = 9  # gains are rounded, so that ties are ties on any machine


def equal_widths(df: DataFrame, dim: int, bins: int = BINS, features: str = "features") -> np.ndarray:
    """(dim, bins - 1) thresholds between each feature's smallest and largest
    value; a row is in bin b if it passes b thresholds (x > threshold)."""
    ends = df.agg(*(f(F.col(features)[j]).alias(f"{n}{j}") for j in range(dim) for n, f in (("low", F.min), ("high", F.max)))).first()
    low, high = (np.array([np.nan if ends[f"{n}{j}"] is None else ends[f"{n}{j}"] for j in range(dim)], float) for n in ("low", "high"))
    return low[:, None] + (high - low)[:, None] * np.arange(1, bins)[None, :] / bins


class Tree:
    """``splits``: node -> (feature, bin, threshold); node i's children are 2i
    and 2i + 1, the root is 1.  ``values`` and ``sizes``: node -> prediction,
    and rows that reach it."""

    def __init__(self, thresholds: np.ndarray):
        self.thresholds, self.splits, self.values, self.sizes = thresholds, {}, {}, {}

    def frame(self, spark) -> DataFrame:
        """One row a node: node, feature and threshold (null in leaves), size,
        prediction."""
        rows = [(i, *(self.splits[i][::2] if i in self.splits else (None, None)), self.sizes[i], self.values[i]) for i in sorted(self.values)]
        return spark.createDataFrame(rows, "node long, feature int, threshold double, size long, prediction double")

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(t, x[:, j], side="left") for j, t in enumerate(self.thresholds)], axis=1)

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        node = np.ones(len(bins), np.int64)
        for i in sorted(self.splits):  # parents before children
            at = np.flatnonzero(node == i)
            feature, cut, _ = self.splits[i]
            node[at] = 2 * i + (bins[at, feature] > cut)
        return node


def _histogram(tree: Tree, kind: str, classes: int, live: set[int]):
    """Task that adds up (node, feature, bin, k, n, s, q): rows, and for
    numbers sums and sums of squares, for classes a row per class k."""
    def task(batches):
        total: dict[tuple, np.ndarray] = {}
        shape = None
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column("features").flatten(), float).reshape(b.num_rows, -1)
            y = b.column("label").to_numpy(zero_copy_only=False).astype(float)
            bins = tree.bins(x)
            node = tree.route(bins)
            width = tree.thresholds.shape[1] + 1
            shape = (x.shape[1], width, classes)
            base = (np.arange(x.shape[1])[None, :] * width + bins) * classes
            cell = (base + (y[:, None].astype(np.int64) if kind == "class" else 0)).astype(np.int64)
            for i in np.unique(node):
                if int(i) not in live:
                    continue
                at = node == i
                c = cell[at].ravel()
                yy = np.repeat(y[at], x.shape[1])
                h = total.setdefault(int(i), np.zeros((3, int(np.prod(shape)))))
                h[0] += np.bincount(c, minlength=h.shape[1])
                if kind == "number":
                    h[1] += np.bincount(c, yy, minlength=h.shape[1])
                    h[2] += np.bincount(c, yy * yy, minlength=h.shape[1])
        for i, h in total.items():
            at = np.flatnonzero(h[0])
            f, b, k = np.unravel_index(at, shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(f.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(k.astype(np.int32)),
                                              *(pa.array(h[r][at]) for r in range(3))], names=["node", "feature", "bin", "k", "n", "s", "q"])
    return task


def _impurity(n: Column, s: Column, q: Column, kind: str) -> Column:
    """n times the impurity: n - sum of squares / n for classes (q holds the sum
    of squared class counts), the sum of squared errors for numbers."""
    return F.when(n > 0, (n - q / n) if kind == "class" else (q - s * s / n)).otherwise(0.0)


def grow(df: DataFrame, kind: str, depth: int, thresholds: np.ndarray, classes: int = 1) -> Tree:
    """A tree on ``(label, features)`` rows; ``kind`` is ``class`` (labels 0 to
    ``classes`` - 1) or ``number``.  Rows with a null label or null features
    take no part; without rows the tree has no node at all."""
    if kind not in ("class", "number"):
        raise ValueError("kind is class or number")
    tree = Tree(np.asarray(thresholds, float))
    src = df.select(F.col("label").cast("double").alias("label"), F.col("features").cast("array<double>").alias("features")).dropna()
    live = {1}
    for level in range(depth + 1):
        hist = (src.mapInArrow(_histogram(tree, kind, classes if kind == "class" else 1, live), "node long, feature int, bin int, k int, n double, s double, q double")
                .groupBy("node", "feature", "bin", "k").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q"))))
        # what lies at or below each bin, per class, then over classes
        upto = Window.partitionBy("node", "feature", "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy("node", "feature", "k")
        if kind == "class":
            # a class need not occur in every bin: fill the grid of bins that occur
            grid = hist.select("node", "feature", "bin").distinct().join(hist.select("node", "feature", "k").distinct(), ["node", "feature"])
            hist = grid.join(hist, ["node", "feature", "bin", "k"], "left").fillna(0.0, ["n", "s", "q"])
        run = hist.select("*", *(F.sum(c).over(upto).alias(f"l{c}") for c in "nsq"), *(F.sum(c).over(whole).alias(f"t{c}") for c in "nsq"))
        square = (lambda c: F.sum(F.col(f"{c}n") * F.col(f"{c}n"))) if kind == "class" else (lambda c: F.sum(f"{c}q"))
        right = run.withColumns({f"r{c}": F.col(f"t{c}") - F.col(f"l{c}") for c in "nsq"})
        side = right.groupBy("node", "feature", "bin").agg(*(F.sum(f"{p}{c}").alias(f"{p}{c}") for p in "lrt" for c in "ns"), *(square(p).alias(f"{p}q") for p in "lrt"))
        cost = lambda p: _impurity(F.col(f"{p}n"), F.col(f"{p}s"), F.col(f"{p}q"), kind)
        gain = F.when(cost("t") > 0, F.round((cost("t") - cost("l") - cost("r")) / cost("t"), PLACES)).otherwise(0.0)
        best = side.withColumn("gain", F.when((F.col("ln") > 0) & (F.col("rn") > 0), gain).otherwise(0.0)).withColumn(
            "place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("gain"), "feature", "bin"))).filter("place = 1")
        if kind == "class":
            count = hist.filter("feature = 0").groupBy("node", "k").agg(F.sum("n").alias("n"))
            value = count.groupBy("node").agg(F.max_by("k", F.struct("n", -F.col("k"))).cast("double").alias("value"))
        else:
            value = hist.filter("feature = 0").groupBy("node").agg((F.sum("s") / F.sum("n")).alias("value"))
        rows = best.join(value, "node").select("node", "feature", "bin", "gain", "value", F.col("tn").alias("size")).collect()  # one row a node
        live = set()
        for r in rows:
            tree.values[r.node], tree.sizes[r.node] = r.value, int(r.size)
            if level < depth and r.gain > LEAST:
                tree.splits[r.node] = (r.feature, r.bin, float(tree.thresholds[r.feature, r.bin]))
                live |= {2 * r.node, 2 * r.node + 1}
        if not live:
            break
    return tree


def predict(df: DataFrame, tree: Tree, features: str = "features") -> DataFrame:
    """Adds ``prediction`` as one nested conditional expression (null where the
    features are null or the tree is empty)."""
    def expr(i: int) -> Column:
        if i not in tree.splits:
            return F.lit(tree.values.get(i))
        feature, _, cut = tree.splits[i]
        return F.when(F.col(features)[feature] > cut, expr(2 * i + 1)).otherwise(expr(2 * i))

    return df.withColumn("prediction", F.when(F.col(features).isNotNull(), expr(1).cast("double")))
