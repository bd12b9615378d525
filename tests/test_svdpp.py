import numpy as np
import pytest

from support import shuffle_files
from tessera.operators.svdpp import SvdConf, start_constants, svd_plus_plus


def test_svdpp_one_step_matches_numpy(spark):
    rng = np.random.default_rng(0)
    E = [(int(u), 100 + int(i), float(rng.integers(1, 6))) for u, i in
         zip(rng.integers(0, 6, 30), rng.integers(0, 5, 30))]
    edges = spark.createDataFrame(E, "src long, dst long, rating double")
    conf0 = SvdConf(rank=4, max_iters=0)
    v0, u = svd_plus_plus(edges, conf0, seed=3)
    init = {r["id"]: (np.array(r["v1"]), np.array(r["v2"]), r["b"]) for r in v0.collect()}
    deg = {}
    for s, d, _ in E:
        deg[s] = deg.get(s, 0) + 1
        deg[d] = deg.get(d, 0) + 1
    n = {k: 1 / np.sqrt(c) for k, c in deg.items()}
    assert u == pytest.approx(np.mean([r for _, _, r in E]))
    v1 = {k: x[0].copy() for k, x in init.items()}
    v2 = {k: x[1].copy() for k, x in init.items()}
    b = {k: x[2] for k, x in init.items()}
    c = SvdConf(rank=4, max_iters=1)
    # phase 1
    ys = {}
    for s, d, _ in E:
        ys[s] = ys.get(s, 0) + v2[d]
    for s in ys:
        v2[s] = v1[s] + n[s] * ys[s]
    # phase 2
    m1 = {k: np.zeros(4) for k in v1}
    m2 = {k: np.zeros(4) for k in v1}
    m3 = {k: 0.0 for k in v1}
    for s, d, r in E:
        p, z, q, y = v1[s], v2[s], v1[d], v2[d]
        pred = min(max(u + b[s] + b[d] + q @ z, c.min_val), c.max_val)
        err = r - pred
        m1[s] += (err * q - c.gamma7 * p) * c.gamma2
        m2[s] += (err * n[s] * q - c.gamma7 * y) * c.gamma2
        m3[s] += (err - c.gamma6 * b[s]) * c.gamma1
        m1[d] += (err * z - c.gamma7 * q) * c.gamma2
        m2[d] += (err * n[s] * q - c.gamma7 * y) * c.gamma2
        m3[d] += (err - c.gamma6 * b[d]) * c.gamma1
    for k in v1:
        v1[k] = v1[k] + m1[k]
        v2[k] = v2[k] + m2[k]
        b[k] = b[k] + m3[k]
    se = {}
    for s, d, r in E:
        pred = min(max(u + b[s] + b[d] + v1[d] @ v2[s], c.min_val), c.max_val)
        se[d] = se.get(d, 0) + (r - pred) ** 2
    v, _ = svd_plus_plus(edges, c, seed=3)
    got = {r["id"]: r for r in v.collect()}
    for k in v1:
        assert np.allclose(got[k]["v1"], v1[k])
        assert np.allclose(got[k]["v2"], v2[k])
        assert got[k]["b"] == pytest.approx(b[k])
        want_n = se[k] if k in se else n[k]
        assert got[k]["n"] == pytest.approx(want_n)


def test_rank_over_several_blocks_and_vertices_on_both_sides(spark):
    """Rank 23 takes three blocks of components; vertex 2 is user and item."""
    E = [(1, 2, 4.0), (2, 3, 1.0), (2, 9, 5.0), (1, 9, 2.0), (5, 2, 3.0)]
    edges = spark.createDataFrame(E, "src long, dst long, rating double")
    conf = SvdConf(rank=23)
    v0, u = svd_plus_plus(edges, SvdConf(rank=23, max_iters=0))
    old = {r["id"]: r for r in v0.collect()}
    deg = {x: sum(x in (s, d) for s, d, _ in E) for x in old}
    n = {x: deg[x] ** -0.5 for x in old}
    v1, b = {x: np.array(r["v1"]) for x, r in old.items()}, {x: r["b"] for x, r in old.items()}
    first = {x: np.array(r["v2"]) for x, r in old.items()}
    v2 = {x: v1[x] + n[x] * sum(first[d] for s, d, _ in E if s == x) if any(s == x for s, _, _ in E) else first[x] for x in old}
    m1, m2 = {x: np.zeros(23) for x in old}, {x: np.zeros(23) for x in old}
    for s, d, r in E:
        err = r - min(max(u + b[s] + b[d] + v1[d] @ v2[s], 0.0), 5.0)
        up_y = (err * n[s] * v1[d] - conf.gamma7 * v2[d]) * conf.gamma2
        m1[s] += (err * v1[d] - conf.gamma7 * v1[s]) * conf.gamma2
        m1[d] += (err * v2[s] - conf.gamma7 * v1[d]) * conf.gamma2
        m2[s] += up_y
        m2[d] += up_y
    for r in svd_plus_plus(edges, conf)[0].collect():
        assert np.allclose(r["v1"], v1[r["id"]] + m1[r["id"]])
        assert np.allclose(r["v2"], v2[r["id"]] + m2[r["id"]])


def test_start_is_the_stated_rule(spark):
    v, _ = svd_plus_plus(spark.createDataFrame([(7, 11, 1.0)], "src long, dst long, rating double"), SvdConf(rank=3, max_iters=0))
    for r in v.collect():
        want = [(r["id"] + 48271) * a % (2 ** 31 - 1) / (2 ** 31 - 1) for a in start_constants(3, 0, 1)]
        assert r["v1"] == pytest.approx(want, abs=1e-15)


def _by_loops(E, start, b, n, u, conf):
    """SVD++ edge by edge; edges without an end are out, without a rating they have no error."""
    v1, v2, b = ({k: np.array(start[k][0]) for k in start}, {k: np.array(start[k][1]) for k in start}, dict(b))
    E = [x for x in E if x[0] is not None and x[1] is not None]

    def error(s, d, r):
        return 0.0 if r is None else r - min(max(u + b[s] + b[d] + v1[d] @ v2[s], conf.min_val), conf.max_val)

    for _ in range(conf.max_iters):
        v2 |= {k: v1[k] + n[k] * sum(v2[d] for s, d, _ in E if s == k) for k in {s for s, _, _ in E}}
        m1, m2, m3 = {k: 0 * x for k, x in v1.items()}, {k: 0 * x for k, x in v2.items()}, dict.fromkeys(b, 0.0)
        for s, d, r in E:
            err = error(s, d, r)
            for k, other in ((s, v1[d]), (d, v2[s])):
                m1[k] += conf.gamma2 * (err * other - conf.gamma7 * v1[k])
                m2[k] += conf.gamma2 * (err * n[s] * v1[d] - conf.gamma7 * v2[d])
                m3[k] += conf.gamma1 * (err - conf.gamma6 * b[k])
        v1, v2, b = ({k: x[k] + m[k] for k in x} for x, m in ((v1, m1), (v2, m2), (b, m3)))
    se = {}
    for s, d, r in E:
        if r is not None:
            se[d] = se.get(d, 0.0) + error(s, d, r) ** 2
    return v1, v2, b, {**n, **se}


def test_many_cells_and_steps_match_loops_and_no_edge_carries_a_vector(spark, monkeypatch):
    """Cells of a few vertices, repeated edges, vertex 2 on both sides, nulls; two steps, the second with sent vectors."""
    from tessera.operators import svdpp
    for name, few in (("_BLOCK", 3), ("_EDGES", 8)):
        monkeypatch.setattr(svdpp, name, few, raising=False)
    rng = np.random.default_rng(5)
    E = [(int(s), int(d), float(r)) for s, d, r in zip(rng.integers(0, 8, 60), rng.integers(20, 30, 60), rng.integers(1, 6, 60))]
    E += [E[0], E[0], (1, 2, 4.0), (2, 25, 1.0), (3, 21, None), (None, 22, 3.0), (4, None, 2.0)]
    edges = spark.createDataFrame(E, "src long, dst long, rating double")
    v0, u = svd_plus_plus(edges, SvdConf(rank=13, max_iters=0))
    assert v0._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # of the vertices, none of the edges
    rows = {r["id"]: r for r in v0.collect() if r["id"] is not None}
    deg = {k: sum(k in (s, d) for s, d, _ in E) for k in rows}
    n = {k: c ** -0.5 for k, c in deg.items()}
    conf = SvdConf(rank=13, max_iters=2)
    v1, v2, b, last = _by_loops(E, {k: (r["v1"], r["v2"]) for k, r in rows.items()},
                                {k: r["b"] for k, r in rows.items()}, n, u, conf)
    got = {r["id"]: r for r in svd_plus_plus(edges, conf)[0].collect() if r["id"] is not None}
    assert got.keys() == rows.keys()
    for k, r in got.items():
        assert np.allclose(r["v1"], v1[k]) and np.allclose(r["v2"], v2[k])
        assert r["b"] == pytest.approx(b[k]) and r["n"] == pytest.approx(last[k])


def test_shuffle_files_of_finished_steps_are_gone(spark):
    """Training leaves no shuffle on disk; the last plan still runs, more than once."""
    import time
    rng = np.random.default_rng(9)
    E = [(int(s), int(d), float(r)) for s, d, r in zip(rng.integers(0, 8, 60), rng.integers(20, 30, 60), rng.integers(1, 6, 60))]
    edges = spark.createDataFrame(E, "src long, dst long, rating double")
    before, key = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    v, _ = svd_plus_plus(edges, SvdConf(rank=3, max_iters=2))
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(key, None) == was
    assert sorted(r["id"] for r in v.collect()) == sorted(r["id"] for r in v.collect())
