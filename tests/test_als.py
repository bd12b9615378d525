import numpy as np
import pytest

from tessera.operators.als import als_normal, als_search, score_factors
from tessera.operators.svdpp import start_constants

SCHEMA = "user long, item long, rating double"
P = 2 ** 31 - 1


def _ratings(n=120, users=9, items=7):
    rng = np.random.default_rng(2)
    return [(int(u) + 2 ** 40, int(i), float(r)) for u, i, r in
            zip(rng.integers(0, users, n), rng.integers(0, items, n), rng.integers(1, 6, n))]


def _scalar(rows, rank, iters, reg):
    v = {i: np.array([(i + 48271) * a % P / P for a in start_constants(rank, 0, 1)]) for _, i, _ in rows}
    u = {}
    for _ in range(iters):
        for mine, key, other, oth in ((u, 0, 1, v), (v, 1, 0, u)):
            for x in {r[key] for r in rows}:
                own = [r for r in rows if r[key] == x]
                f = np.array([oth[r[other]] for r in own])
                mine[x] = np.linalg.solve(f.T @ f + reg * len(own) * np.eye(rank), f.T @ np.array([r[2] for r in own]))
    return u, v


def test_factors_match_a_scalar_run(spark):
    rows = _ratings()
    users, items = als_normal(spark.createDataFrame(rows, SCHEMA).repartition(5), 4, 3, 0.05)
    u, v = _scalar(rows, 4, 3, 0.05)
    got_u, got_v = ({r[0]: r[1] for r in d.collect()} for d in (users, items))
    assert set(got_u) == set(u) and set(got_v) == set(v)
    assert all(np.allclose(got_u[x], u[x]) for x in u) and all(np.allclose(got_v[x], v[x]) for x in v)


def test_nulls_empty_and_unseen(spark):
    rows = _ratings(30)
    more = rows + [(None, 1, 2.0), (5, None, 2.0), (6, 1, None)]
    users, items = als_normal(spark.createDataFrame(more, SCHEMA), 2, 1, 0.1)
    assert {r[0] for r in users.collect()} == {r[0] for r in rows}
    data = spark.createDataFrame([(rows[0][0], rows[0][1], "a"), (1, 1, "b"), (None, 1, "c")], "user long, item long, note string")
    got = {r["note"]: r["prediction"] for r in score_factors(data, users, items, 2, 9.5).collect()}
    assert got["b"] == got["c"] == 9.5 and got["a"] != 9.5
    users, items = als_normal(spark.createDataFrame([], SCHEMA), 2, 1, 0.1)
    assert users.count() == items.count() == 0


def test_search_keeps_the_best(spark):
    rows = _ratings(200)
    a, b, c = (spark.createDataFrame(rows[k::3], SCHEMA) for k in range(3))
    got = als_search(a, b, c, ranks=(1, 2), regs=(0.05, 1.0), iters=(1,)).collect()
    assert len(got) == 4 and [r["best"] for r in got].count(True) == 1
    best = min(got, key=lambda r: r["valid_rmse"])
    assert best["best"] and best["n_test"] == len(rows[2::3]) and all(r["n_valid"] == len(rows[1::3]) for r in got)
    u, v = _scalar(rows[::3], best["rank"], 1, best["reg"])
    mu = np.mean([r[2] for r in rows[::3] + rows[1::3]])
    err = [(u[x] @ v[i] if x in u and i in v else mu) - r for x, i, r in rows[2::3]]
    assert best["test_rmse"] == pytest.approx(np.sqrt(np.mean(np.square(err))))
    none = als_search(a, b.limit(0), c, ranks=(1,), regs=(0.1,), iters=(1,)).collect()
    assert none[0]["best"] is False and none[0]["valid_rmse"] is None


def test_settings_are_checked(spark):
    with pytest.raises(ValueError):
        als_normal(spark.createDataFrame([], SCHEMA), 2, 1, 0.0)


def test_ratings_are_summed_where_they_are_sent(spark):
    """No partial sums of one vector each go through a shuffle."""
    from tessera.operators import als
    from tessera.operators.iterate import cut_to_table
    r = cut_to_table(spark.createDataFrame([(u, i, 1.0 * (u + i)) for u in range(9) for i in range(4)], "user long, item long, rating double"))
    f = cut_to_table(spark.createDataFrame([(i, [1.0, 2.0 + i]) for i in range(4)], "item long, factors array<double>"))
    plan = als._half(r, f, "user", "item", 2, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "_i#" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
