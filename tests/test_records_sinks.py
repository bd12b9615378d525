import os

import pytest

from support import rows
from tessera.operators import sortbench as S
from tessera.sources import sinks
from tessera.sources.records import read_records


def _files(path):
    return sorted(f for f in os.listdir(path) if f.startswith("part-"))


def test_records_are_read_in_file_and_record_order(spark, tmp_path):
    recs = S.generate(spark, 1000, 1).collect()
    for i in range(3):
        (tmp_path / f"part-{i}").write_bytes(b"".join(bytes(r["key"]) + bytes(r["value"]) for r in recs[i * 400:(i + 1) * 400]))
    back = read_records(spark, str(tmp_path), split_bytes=10_000)  # several splits a file
    assert [(bytes(r["key"]), bytes(r["value"])) for r in back.collect()] == [(bytes(r["key"]), bytes(r["value"])) for r in recs]


def test_sorted_files_are_in_key_order(spark, tmp_path):
    recs = S.generate(spark, 5000, 3)
    path = str(tmp_path / "sorted")
    S.write_sorted(recs, path, 4)
    files = _files(path)
    assert len(files) == 4 and "_SUCCESS" in os.listdir(path)
    keys = [bytes(r["key"]) for f in files for r in spark.read.parquet(f"{path}/{f}").collect()]
    assert keys == sorted(bytes(r["key"]) for r in recs.collect())
    v = S.validate_files(spark, path).first()
    assert (v["records"], v["violations"], v["partitions"]) == (5000, 0, 4)
    assert v["checksum"] == S.checksum(recs).first()["checksum"]


@pytest.mark.parametrize("split", ["128m", "20k"])
def test_swapped_files_are_violations(spark, tmp_path, split):
    path = tmp_path / "sorted"
    S.write_sorted(S.generate(spark, 5000, 3), str(path), 4)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert S.validate_files(spark, str(path)).first()["violations"] == 0
        a, b = (path / f for f in _files(path)[1:3])
        a.rename(path / "x"), b.rename(a), (path / "x").rename(b)
        for f in path.glob(".*.crc"):
            f.unlink()
        v = S.validate_files(spark, str(path)).first()
        assert v["records"] == 5000 and v["violations"] >= 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_an_unsorted_row_inside_a_file_is_a_violation(spark, tmp_path):
    rows = [(bytes([i]), b"v", 0) for i in (1, 2, 5, 4, 6)]
    spark.createDataFrame(rows, "key binary, value binary, part int").coalesce(1).write.parquet(str(tmp_path / "one"))
    assert S.validate_files(spark, str(tmp_path / "one")).first()["violations"] == 1


def test_records_reject_partial_record(spark, tmp_path):
    d = tmp_path / "bad"
    d.mkdir()
    (d / "part-0").write_bytes(b"x" * 150)
    with pytest.raises(Exception):
        read_records(spark, str(d)).count()


def test_pairs_text_and_sampling(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5)], "id long, rank double")
    p = str(tmp_path / "pairs")
    sinks.write_pairs_text(df, p, ["id", "rank"])
    assert sorted(r["value"] for r in spark.read.text(p).collect()) == ["1 0.5", "2 1.5"]
    big = spark.range(1000)
    a = sinks.bernoulli_sample(big, 0.9, 11).count()
    assert 850 < a < 950 and a == sinks.bernoulli_sample(big, 0.9, 11).count()
    t = sinks.take_random(big, 7, 42)
    assert t.count() == 7 and rows(t) == rows(sinks.take_random(big, 7, 42))

