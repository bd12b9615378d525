import numpy as np
import pytest

from tessera.operators import trees as T


def brute(x, y, kind, depth, thresholds):
    """Depth-first growth over explicit row sets."""
    out = {}

    def cost(v):
        if not len(v):
            return 0.0
        if kind == "class":
            return len(v) - (np.bincount(v.astype(int)) ** 2).sum() / len(v)
        return float((v * v).sum() - v.sum() ** 2 / len(v))

    def visit(node, at, level):
        v = y[at]
        value = float(np.bincount(v.astype(int)).argmax()) if kind == "class" else float(v.mean())
        best = (0.0, None)
        for f in range(x.shape[1]):
            for t in thresholds[f]:
                go = x[at, f] > t
                if go.all() or not go.any() or cost(v) <= 0:
                    continue
                gain = round((cost(v) - cost(v[go]) - cost(v[~go])) / cost(v), 9)
                if gain > best[0]:
                    best = (gain, (f, float(t)))
        out[node] = (best[1] if level < depth and best[0] > T.LEAST else None, len(at), value)
        if out[node][0]:
            f, t = out[node][0]
            visit(2 * node, at[x[at, f] <= t], level + 1)
            visit(2 * node + 1, at[x[at, f] > t], level + 1)

    visit(1, np.arange(len(y)), 0)
    return out


@pytest.mark.parametrize("kind", ["class", "number"])
def test_tree_equals_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)).round(2)
    y = ((x[:, 0] > 0.3).astype(int) + 2 * (x[:, 1] * x[:, 0] > 0.1)).astype(float) if kind == "class" else (x[:, 0] * 3 + np.abs(x[:, 1])).round(3)
    y[:40] = rng.integers(0, 4, 40)
    df = spark.createDataFrame([(float(b), [float(v) for v in a]) for a, b in zip(x, y)] + [(None, [0.0, 0.0, 0.0]), (1.0, None)],
                               "label double, features array<double>").repartition(3)
    cuts = T.equal_widths(df.dropna(), 3, 8)
    tree = T.grow(df, kind, 3, cuts, 4)
    want = brute(x, y, kind, 3, cuts)
    assert tree.values.keys() == want.keys() and len(want) > 7
    for node, (split, size, value) in want.items():
        assert (tree.splits[node][0], tree.splits[node][2]) == split if split else node not in tree.splits
        assert tree.sizes[node] == size and tree.values[node] == pytest.approx(value)
    got = T.predict(df, tree).collect()
    leaf = tree.route(tree.bins(x))
    assert sorted(r.prediction for r in got if r.features is not None and r.label is not None) == pytest.approx(sorted(tree.values[int(i)] for i in leaf))
    assert [r.prediction for r in got if r.features is None] == [None]


def test_tree_edge_cases(spark):
    empty = spark.createDataFrame([], "label double, features array<double>")
    tree = T.grow(empty, "number", 3, np.zeros((2, 3)))
    assert tree.values == {} and tree.frame(spark).count() == 0
    same = spark.createDataFrame([(2.0, [1.0]), (2.0, [5.0])], "label double, features array<double>")
    tree = T.grow(same, "number", 3, T.equal_widths(same, 1, 4))
    assert tree.splits == {} and tree.values == {1: 2.0} and tree.sizes == {1: 2}
    with pytest.raises(ValueError):
        T.grow(same, "other", 1, np.zeros((1, 3)))
