import math
from collections import Counter

from pyspark.sql import functions as F

from tessera.streaming import sketches as SK
from tessera.streaming.runner import dir_stream, run_to_table


def _folder(spark, tmp_path, rows):
    for i in range(3):
        spark.createDataFrame(rows[i::3], "key long, part int").coalesce(1).write.parquet(str(tmp_path / f"f{i}"))
    return dir_stream(spark, str(tmp_path / "*"), "key long, part int", max_files_per_trigger=1)


def test_merged_count_min_equals_one_sketch(spark, tmp_path):
    rows = [(k * k % 501 - 20, k % 2) for k in range(3000)] + [(7, 0)] * 200 + [(2**40 + 3, 1)] * 100
    per = run_to_table(_folder(spark, tmp_path, rows), per_batch=lambda b, _: SK.heavy_batch(b, "key", 0.02, 64, ("part",)))
    assert per.select("batch").distinct().count() == 3
    whole = SK.count_min(spark.createDataFrame(rows, "key long, part int"), "key", 64, ("part",))
    merged = SK.merge(per.filter("hit is null"), ("part",))
    key = lambda d: sorted(map(tuple, d.select("part", "row", "cell", "n").collect()))
    assert key(merged) == key(whole)

    def cell(k, a, b):
        return (k % SK.PRIME * a + b) % SK.PRIME % 64
    exact = {p: Counter(k for k, q in rows if q == p) for p in (0, 1)}
    hits = {}
    for p, count in exact.items():
        table = [Counter() for _ in SK.HASHES]
        for k, n in count.items():
            for t, (a, b) in zip(table, SK.HASHES):
                t[cell(k, a, b)] += n
        for k in count:
            est = min(t[cell(k, a, b)] for t, (a, b) in zip(table, SK.HASHES))
            assert est >= count[k]
            if est >= 0.02 * sum(count.values()):
                hits[p, k] = est
    found = {(r.part, r.key): r.estimate for r in SK.heavy_hitters(per, 0.02, 64, ("part",)).collect()}
    # every true heavy hitter is among the batches' candidates
    assert found.items() <= hits.items() and (0, 7) in found and (1, 2**40 + 3) in found
    assert all((p, k) in found for p, c in exact.items() for k, n in c.items() if n >= 0.02 * sum(c.values()))


def test_error_bound(spark):
    assert spark.range(1).select(SK.error_bound(F.lit(1000), 272)).first()[0] == math.ceil(1000 * math.e / 272)


def test_union_of_sketches_equals_one_sketch(spark, tmp_path):
    rows = [(k % 5000, k % 2) for k in range(12000)]
    per = run_to_table(_folder(spark, tmp_path, rows), per_batch=lambda b, _: SK.distinct_batch(b, "key", ("part",)))
    one = spark.createDataFrame(rows, "key long, part int").groupBy("part").agg(F.hll_sketch_estimate(F.hll_sketch_agg("key", 12)).alias("estimate"))
    got = {r.part: r.estimate for r in SK.distinct_union(per, ("part",)).collect()}
    assert per.count() == 6 and set(got) == {0, 1}
    for r in one.collect():
        assert abs(got[r.part] - 2500) < 0.065 * 2500 and abs(got[r.part] - r.estimate) <= 0.03 * r.estimate
