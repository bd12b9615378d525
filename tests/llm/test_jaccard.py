import itertools
from collections import Counter
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard as J
from tessera.llm import queries


LAW = J.Law()


def shingles(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n=4, percent=85):
    """doc_id -> (set size, smallest id reachable by links); ids are unique."""
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed=1):
    """Texts of many sizes with copies at every distance around the limit."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    out = []
    for size in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 24, 30, 41, 55, 70, 100, 180, 400):
        base = [word() for _ in range(size)]
        out.append(" ".join(base))
        for edits in (0, 1, 1, 2, 2, 3, 4, 5, 6, 8):
            w = list(base)
            for _ in range(edits if size > 6 else min(edits, 1)):
                at = rng.randrange(len(w))
                how = rng.randrange(3)
                if how == 0:
                    w[at] = word()
                elif how == 1:
                    w.insert(at, word())
                elif len(w) > 1:
                    del w[at]
            out.append(" ".join(w))
        out.append(" ".join(base + [word() for _ in range(max(1, size // 7))]))
        out.append(" ".join(base[: max(1, size - size // 8)]))
    rng.shuffle(out)
    return out


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_near_copies_equal_brute_force(spark):
    rows = [(i * 7, t) for i, t in enumerate(near_copies())]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(J.jaccard_components(d)) == brute(rows)


def test_other_similarity_and_shingle_length(spark):
    rows = [(i, t) for i, t in enumerate(near_copies(2))]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, g string")
    want = brute(rows, 5, 80)
    assert result(J.jaccard_components(d, 5, 80)) == want
    one = J.keep_one(d.union(d.limit(9)))
    assert one.columns == d.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_edge_cases_equal_brute_force(spark, docs, empty):
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    out = J.jaccard_components(docs)
    got = result(out.filter("doc_id is not null"))
    assert got == brute(rows.items())
    assert out.count() == docs.count()
    assert [r.component_id for r in out.filter("doc_id is null").collect()] == [None]
    assert J.jaccard_components(empty).count() == 0


def test_star_alone_would_miss_links_that_cross_search_finds(spark):
    """A hub group whose members mostly differ too much from each other."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 5, 6, 7, 8])):
            w[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(J.jaccard_components(d)) == brute(rows)


def test_pigeonhole_guarantee():
    """Linked sets always share a key at the smaller one's level."""
    rng = np.random.default_rng(4)
    for _ in range(1500):
        n = int(rng.integers(1, 60))
        a = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        drop = int(rng.integers(0, 1 + n // 5))
        b = np.concatenate([a[drop:], rng.integers(0, 1 << 62, int(rng.integers(0, 1 + n // 5)), dtype=np.uint64)])
        k, u = n - drop, n + len(b) - (n - drop)
        if not len(b) or 100 * k < 85 * u:
            continue
        keys = [set().union(*(J.level_keys(LAW, np.array([0, len(x)]), np.sort(x), s)[1].tolist() for s in (0, 1))) for x in (a, b)]
        assert keys[0] & keys[1]


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = rng.integers(0, 1 << 62, 80, dtype=np.uint64)
        b = np.concatenate([a[: int(rng.integers(1, 80))], rng.integers(0, 1 << 62, 20, dtype=np.uint64)])
        x, y = J.bit_sketch(a, 512), J.bit_sketch(b, 256)
        d = np.bitwise_count(J.fold(x, 32) ^ y).sum()
        assert d <= len(set(a.tolist()) ^ set(b.tolist()))


def test_search_blocks_find_the_same_pairs(spark):
    rows = [(i, t) for i, t in enumerate(near_copies(9))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets = J.cut_to_table(J.set_table(d, LAW).filter("n > 0").dropDuplicates(["g"]))
    keys = J.cut_to_table(J.shared_keys(d, LAW))
    comp = sets.select("g", J.F.col("g").alias("c"))
    pairs = lambda block: {(r.a, r.b) for r in J.cross_pairs(keys, sets, comp, LAW, block).collect()}
    big, small = pairs(2048), pairs(3)
    assert big == small and len(big) > 10


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(queries.ORACLES["op1_parity_jaccard"]).fetchall()}
    got = result(queries.op1_parity_jaccard(spark, sf))
    assert got == want and any(c != i for i, (_, c) in got.items())


def test_blocks_of_a_key_with_many_components(spark):
    """10,000 sets of different components on one key: no group passes two
    blocks, and every pair of sets meets exactly once."""
    n, block = 10_000, 512
    keys = spark.range(n).selectExpr("cast(7 as long) key", "id g", "id c").union(
        spark.range(3 * block).selectExpr("cast(8 as long) key", "id + 100000 g", "if(id < 40, id, -1L) c"))
    dealt = J.deal_blocks(keys, block)
    sizes = dealt.groupBy("key", "j").count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * block * 1.3
    small = J.deal_blocks(keys.filter("g < 300 or (key = 8 and g < 100200)"), 16).groupBy("key", "j", "side").agg(F.collect_list("g").alias("g"), F.collect_list("c").alias("c")).collect()
    groups = {}
    for r in small:
        groups.setdefault((r.key, r.j), {})[r.side] = list(zip(r.g, r.c))
    met = Counter()
    for sides in groups.values():
        if 2 in sides:
            met.update(frozenset((a[0], b[0])) for a, b in itertools.combinations(sides[2], 2) if a[1] != b[1])
        met.update(frozenset((a[0], b[0])) for a in sides.get(0, ()) for b in sides.get(1, ()) if a[1] != b[1])
    assert max(met.values()) == 1
    first = {frozenset(p) for p in itertools.combinations(range(300), 2)}
    label = {100000 + i: (i if i < 40 else -1) for i in range(200)}
    second = {frozenset(p) for p in itertools.combinations(label, 2) if label[p[0]] != label[p[1]]}
    assert set(met) == first | second
