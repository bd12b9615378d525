import random
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
import pytest

from support import rows
from tessera.operators import graph as G


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


PR_EDGES = [(1, 2), (1, 2), (2, 3), (3, 2), (4, 2)]


def test_page_rank_simple_first_step(spark):
    r = dict(rows(G.page_rank_simple(edges(spark, PR_EDGES), 1)))
    assert set(r) == {2, 3}
    assert r[2] == pytest.approx(2.70)
    assert r[3] == pytest.approx(1.00)


def test_page_rank_static_keeps_all(spark):
    r = dict(rows(G.page_rank_static(edges(spark, PR_EDGES), 1)))
    assert set(r) == {1, 2, 3, 4}
    assert r[1] == pytest.approx(0.15) and r[4] == pytest.approx(0.15)


def test_page_rank_until_converges_to_static(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 2)])
    a = dict(rows(G.page_rank_until(e, tol=1e-9)))
    b = dict(rows(G.page_rank_static(e, 200, cut_every=20)))
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-6)
    d = G.rank_distance(G.page_rank_until(e, tol=1e-9), G.page_rank_static(e, 200, cut_every=20)).first()[0]
    assert d == pytest.approx(0.0, abs=1e-9)


def test_triangle_fixture(spark):
    e = edges(spark, [(1, 2), (2, 1), (3, 3), (1, 3), (2, 3)])
    assert rows(G.triangle_count(e)) == [(1, 1), (2, 1), (3, 1)]


def _rand_graph(n, m, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def test_triangles_brute_force(spark):
    pairs = _rand_graph(30, 120, 3)
    adj = defaultdict(set)
    for a, b in pairs:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    want = {v: sum(1 for u in adj[v] for w in adj[v] if u < w and w in adj[u]) for v in adj}
    got = dict(rows(G.triangle_count(edges(spark, pairs))))
    assert got == want


def test_components_fixture(spark):
    e = edges(spark, [(1, 2), (3, 4), (4, 3)])
    assert rows(G.connected_components(e)) == [(1, 1), (2, 1), (3, 3), (4, 3)]


def test_components_brute_force(spark):
    pairs = _rand_graph(200, 150, 5) + [(500 + i, 501 + i) for i in range(60)]  # a long path too
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    want = {}
    for v in list(parent):
        want[v] = min(u for u in parent if find(u) == find(v))
    assert dict(rows(G.connected_components(edges(spark, pairs)))) == want


def test_scc_fixture(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])
    assert rows(G.strongly_connected_components(e)) == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_scc_brute_force(spark):
    pairs = _rand_graph(25, 45, 11)
    verts = {v for p in pairs for v in p}
    adj = defaultdict(set)
    for a, b in pairs:
        adj[a].add(b)

    def reach(s):
        seen, q = {s}, deque([s])
        while q:
            x = q.popleft()
            for y in adj[x]:
                if y not in seen:
                    seen.add(y)
                    q.append(y)
        return seen

    R = {v: reach(v) for v in verts}
    want = {v: min(u for u in verts if u in R[v] and v in R[u]) for v in verts}
    assert dict(rows(G.strongly_connected_components(edges(spark, pairs)))) == want


def test_lpa_path_oscillates(spark):
    e = edges(spark, [(1, 2), (2, 3)])
    assert dict(rows(G.label_propagation(e, 1))) == {1: 2, 2: 1, 3: 2}
    assert dict(rows(G.label_propagation(e, 2))) == {1: 1, 2: 2, 3: 1}


def test_two_cliques_lpa(spark):
    e = G.two_cliques(spark, 20)
    assert e.count() == 20 * 20 + 21 * 21 + 1
    lab = G.label_propagation(e, 20)
    counts = dict(rows(lab.groupBy("label").count()))
    assert counts == {0: 20, 20: 21}
    chk = G.check_cliques(lab, 20).first()
    assert chk["b1"] and chk["b2"] and chk["b3"]


def _bfs(adj, s):
    d, q = {s: 0}, deque([s])
    while q:
        x = q.popleft()
        for y in adj[x]:
            if y not in d:
                d[y] = d[x] + 1
                q.append(y)
    return d


def test_landmarks_and_sssp_brute_force(spark):
    pairs = _rand_graph(40, 90, 17)
    verts = {v for p in pairs for v in p}
    fwd, rev = defaultdict(set), defaultdict(set)
    for a, b in pairs:
        fwd[a].add(b)
        rev[b].add(a)
    e = edges(spark, pairs)
    lm = sorted(verts)[:2]
    want = {(v, l, h) for l in lm for v, h in _bfs(rev, l).items()}
    assert set(rows(G.landmark_hops(e, lm))) == want
    src = sorted(verts)[0]
    d = _bfs(fwd, src)
    want2 = {v: float(d.get(v, float("inf"))) for v in verts}
    assert dict(rows(G.sssp(e, src))) == want2
    assert dict(rows(G.pregel_sssp(e, src))) == want2


def test_lognormal_graph_is_deterministic(spark):
    a = G.lognormal_graph(spark, 50, seed=3, partitions=2)
    b = G.lognormal_graph(spark, 50, seed=3, partitions=2)
    assert rows(a) == rows(b)
    assert all(0 <= r["dst"] < 50 for r in a.collect())


def _pr_simple_py(pairs, steps):
    e = sorted(set(pairs))
    out = defaultdict(list)
    for a, b in e:
        out[a].append(b)
    ranks = {a: 1.0 for a in out}
    for _ in range(steps):
        s = defaultdict(float)
        for a, r in ranks.items():
            for b in out.get(a, []):
                s[b] += r / len(out[a])
        ranks = {b: 0.15 + 0.85 * x for b, x in s.items()}
    return ranks


def _lpa_py(pairs, steps):
    nb = defaultdict(list)
    for a, b in pairs:
        nb[b].append(a)
        nb[a].append(b)
    lab = {v: v for v in nb}
    for _ in range(steps):
        new = {}
        for v in nb:
            c = defaultdict(int)
            for u in nb[v]:
                c[lab[u]] += 1
            new[v] = min(c, key=lambda k: (-c[k], k))
        lab = new
    return lab


def test_hub_is_salted_and_results_exact(spark):
    rng = random.Random(8)
    pairs = [(0, i) for i in range(1, 400)] + [(i, 0) for i in range(1, 50)] + \
            [(rng.randrange(1, 60), rng.randrange(1, 60)) for _ in range(60)]
    e = edges(spark, pairs)
    ke = G.KeyedEdges(e, "src", "dst", parts=4)
    fan = {r["_fid"]: r["_n"] for r in ke.fan.collect()}
    assert 0 in fan and fan[0] > 1 and len(fan) <= 8
    salts = {r["_salt"] for r in ke.df.filter("src = 0").select("_salt").collect()}
    assert len(salts) > 1
    ke.unpersist()
    kb = G.KeyedEdges(e, "src", "dst", parts=4)
    assert G.KeyedEdges(edges(spark, [(1, 2), (2, 3), (3, 1)]), "src", "dst", parts=1).fan is None
    st = spark.createDataFrame([(0, 1.0), (5, 2.0)], "id long, r double")
    assert rows(kb.join_state(st), "src", "dst") == sorted((a, b) for a, b in pairs if a in (0, 5))
    got = dict(rows(G.page_rank_simple(e, 5)))
    want = _pr_simple_py(pairs, 5)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k])
    assert dict(rows(G.label_propagation(e, 3))) == _lpa_py(pairs, 3)
    fwd = defaultdict(set)
    for a, b in pairs:
        fwd[a].add(b)
    d = _bfs(fwd, 0)
    verts = {v for p in pairs for v in p}
    assert dict(rows(G.sssp(e, 0))) == {v: float(d.get(v, float("inf"))) for v in verts}


def test_loops_finish_or_raise(spark):
    """A bound that is too small is an error, not an unfinished answer."""
    path = edges(spark, [(i, i + 1) for i in range(40)])
    ring = edges(spark, [(i, (i + 1) % 12) for i in range(12)] + [(20, 21), (21, 20)])
    for run in (lambda n: G.connected_components(path, n), lambda n: G.sssp(path, 0, max_iter=n),
                lambda n: G.landmark_hops(path, [40], n), lambda n: G.page_rank_until(ring.union(path), max_iter=n),
                lambda n: G.strongly_connected_components(ring, n)):
        with pytest.raises(RuntimeError, match="not finished after 1 rounds"):
            run(1).count()
    assert {r.component for r in G.connected_components(path).collect()} == {0}
    assert {r.hops for r in G.landmark_hops(path, [40]).collect()} == set(range(41))
    assert {(r.id, r.scc) for r in G.strongly_connected_components(ring).collect()} == {(i, 0) for i in range(12)} | {(20, 20), (21, 20)}


def test_hot_key_join_can_be_split(spark):
    """With a cut side the skewed partition of the hot key is split."""
    from pyspark.sql import functions as F

    from tessera.operators.iterate import join_plain
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        big = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
        out = join_plain(big, big.groupBy("k").count(), "k")
        assert out.agg(F.count("*")).first()[0] == 40_000
        out.write.format("noop").mode("overwrite").save()
        q = out.toPandas()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString() and len(q) == 40_000
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_components_of_bipartite_edges(spark):
    """Every edge goes from a large to a small id, and large ids have several:
    no vertex has neighbours on both sides, yet these are no stars."""
    pairs = [(100 + i, j) for i in range(30) for j in (i, (i * 7 + 1) % 30)] + [(500, 40), (500, 41), (501, 41), (600, 601)]
    got = rows(G.connected_components(spark.createDataFrame(pairs, "src long, dst long")))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == sorted((x, find(x)) for x in {v for p in pairs for v in p})


def test_forest_of_slices(spark, monkeypatch):
    """Slices far smaller than a partition: forests are carried on or put out, and no link is lost."""
    monkeypatch.setattr(G, "_SLICE", 16)
    ends = [np.array(x, np.int64) for x in zip(*[(i, i + 1) for i in range(100)], *[(7, 300 + i) for i in range(40)], (900, 900))]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i:i + 5]) for c in ends], ["u", "v"]) for i in range(0, len(ends[0]), 5)]
    out = [p for b in G._forests(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns))]
    assert all(v <= u for u, v in out) and max(b.num_rows for b in G._forests(iter(batches))) <= 16 + 2 * 5
    seen = {u for u, _ in out}
    assert seen == set(range(101)) | {300 + i for i in range(40)} | {900}
    got = dict(rows(G.connected_components(edges(spark, out))))
    assert got == {u: 900 if u == 900 else 0 for u in seen}
    assert list(G._forests(iter([]))) == []


def test_components_null_ends_and_text_ids(spark):
    """A null end is no vertex; ids may be texts; without edges there are no rows."""
    e = spark.createDataFrame([("b", "c"), ("c", "a"), ("d", None), (None, "e"), (None, None), ("é", "z"), ("z", "z")], "src string, dst string")
    assert rows(G.connected_components(e)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e"), ("z", "z"), ("é", "z")]
    assert rows(G.connected_components(e.filter("src = 'none'"))) == []


def test_scc_leaves_no_plans_or_lineage_behind(spark, monkeypatch):
    """Steps are written tables, not checkpoints that the driver keeps, and superseded ones are deleted."""
    cuts, tables, cut, table, gone = [], [], G.cut, G.cut_to_table, G.release
    monkeypatch.setattr(G, "cut", lambda d: cuts.append(d) or cut(d))
    monkeypatch.setattr(G, "cut_to_table", lambda d: tables.append(table(d)) or tables[-1])
    path = [(i, i + 1) for i in range(9)] + [(9, 20), (20, 21), (21, 22), (22, 20), (22, 30), (30, 31), (31, 30), (40, 40)]
    got = G.strongly_connected_components(edges(spark, path))
    want = {v: v for p in path for v in p} | {20: 20, 21: 20, 22: 20, 30: 30, 31: 30}
    assert dict(rows(got)) == want
    assert len(cuts) <= 4  # at most the salts of hot vertices, for each held edge table
    assert sum(G.is_table(t) for t in tables) <= 4
    with pytest.raises(RuntimeError):
        G.strongly_connected_components(edges(spark, path), max_rounds=1)


def test_components_run_in_small_tasks(spark, monkeypatch):
    """Star rounds run with partitions by their rows, and the settings are as before afterwards."""
    from tessera.operators import iterate
    key, seen, whole = "spark.sql.shuffle.partitions", [], G._stars
    before = spark.conf.get(key)
    with iterate.small_tasks(spark, 10, each=1):
        assert spark.conf.get(key) == "10"
    with pytest.raises(ZeroDivisionError), iterate.small_tasks(spark, 10 ** 6, each=10):
        assert 1 // int(spark.conf.get(key) != "100000")
    monkeypatch.setattr(G, "small_tasks", lambda s, rows: iterate.small_tasks(s, rows, 1))
    monkeypatch.setattr(G, "_stars", lambda *a: seen.append(spark.conf.get(key)) or whole(*a))
    assert rows(G.connected_components(edges(spark, [(i, i + 1) for i in range(7)]))) == [(i, 0) for i in range(8)]
    assert int(seen[0]) > int(before) and spark.conf.get(key) == before
