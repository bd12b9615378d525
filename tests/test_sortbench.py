import zlib

from pyspark.sql import functions as F

from tessera.operators import sortbench as S


def test_binary_order_unsigned(spark):
    df = spark.createDataFrame([(bytes([b]),) for b in (0x7F, 0x80, 0xFF, 0x00)], "key binary")
    got = [bytes(r["key"]) for r in S.total_sort(df, 2).collect()]
    assert got == [b"\x00", b"\x7f", b"\x80", b"\xff"]


def test_range_bucket_top_prefix_clamped(spark):
    df = spark.createDataFrame([(bytes([0xFF] * 10),), (bytes(10),)], "key binary")
    got = sorted(r[0] for r in df.select(S.range_bucket(F.col("key"), 10)).collect())
    assert got == [0, 9]


def test_generator_first_record_and_partition_independence(spark):
    a = S.generate(spark, 40, 1).collect()
    b = S.generate(spark, 40, 3).collect()
    assert [bytes(r["key"]) + bytes(r["value"]) for r in a] == [bytes(r["key"]) + bytes(r["value"]) for r in b]
    x1 = (S.LCG_A * 0 + S.LCG_C) % (1 << 128)
    first = bytes(a[0]["key"]) + bytes(a[0]["value"])
    assert first == S.make_record(x1, 0)
    assert len(first) == 100 and first[10:12] == b"\x00\x11" and first[-4:] == b"\xcc\xdd\xee\xff"
    assert first[12:44] == b"0" * 32
    x = 0
    for _ in range(7):
        x = (S.LCG_A * x + S.LCG_C) % (1 << 128)
    assert S.skip_ahead(7) == x


def test_validate_sorted_and_unsorted(spark):
    recs = S.generate(spark, 500, 4)
    before = S.checksum(recs).first()
    v = S.validate(S.total_sort(recs, 5)).first()
    assert v["records"] == 500 and v["violations"] == 0
    assert v["checksum"] == before["checksum"]
    want = sum(zlib.crc32(bytes(r["key"])) for r in recs.collect())
    assert int(v["checksum"]) == want
    bad = S.validate(recs.repartition(3)).first()
    assert bad["violations"] > 0


def test_size_helpers():
    assert S.size_to_records("10k") == 10_000
    assert S.size_to_records("2m") == 2_000_000
    assert S.records_to_size(10_000_000) == "1000MB"
