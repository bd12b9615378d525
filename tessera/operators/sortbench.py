"""Total-sort benchmark: record generator (TS1), sort and sorted table on disk
(TS2), explicit range partition function (TS3), validators (TS4) and the size
helper (FN11).

Records are 100 bytes: a 10-byte key and a 90-byte value, held as two
binary columns.  Spark compares binary values as unsigned bytes, which is
the order the benchmark requires.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY_LEN = 10
VALUE_LEN = 90
RECORD_LEN = 100

# The 128-bit linear congruential generator of the benchmark,
# X' = (A * X + C) mod 2^128.
LCG_A = 0x2360ED051FC65DA44385DF649FCCF645
LCG_C = 0x4A696D47726179524950202020202001
MASK128 = (1 << 128) - 1

# Separator bytes of the record layout.
BREAK_1 = bytes([0x00, 0x11])
BREAK_2 = bytes([0x88, 0x99, 0xAA, 0xBB])
BREAK_3 = bytes([0xCC, 0xDD, 0xEE, 0xFF])


def size_to_records(size: str) -> int:
    """FN11: ``10k``/``5m``/``2g``/``1t`` (thousands, millions, ... of
    records) or a plain byte count, as a record count."""
    s = size.strip().lower()
    scale = {"k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12}
    if s and s[-1] in scale:
        return int(s[:-1]) * scale[s[-1]]
    return int(s)


def records_to_size(records: int) -> str:
    """FN11 inverse: a byte size in decimal units (records x 100 bytes)."""
    size = records * RECORD_LEN
    for unit, scale in (("TB", 10**12), ("GB", 10**9), ("MB", 10**6), ("KB", 10**3)):
        if size > scale:
            return f"{size // scale}{unit}"
    return f"{size}B"


def _affine_power(n: int) -> tuple[int, int]:
    """(A_n, C_n) with f^n(x) = A_n x + C_n for f(x) = A x + C mod 2^128."""
    ra, rc = 1, 0
    a, c = LCG_A, LCG_C
    while n:
        if n & 1:
            ra, rc = (a * ra) & MASK128, (a * rc + c) & MASK128
        a, c = (a * a) & MASK128, (a * c + c) & MASK128
        n >>= 1
    return ra, rc


def skip_ahead(n: int) -> int:
    """State after ``n`` steps from 0, in O(log n) (parallel generation)."""
    return _affine_power(n)[1]


def make_record(rand: int, record_number: int) -> bytes:
    """Record layout: key = high 10 bytes of the random number; 00 11;
    record number as 32 upper-case hex digits; 88 99 AA BB; hex digits
    20..31 of the random number, each written four times; CC DD EE FF."""
    rb = rand.to_bytes(16, "big")
    hexr = rb.hex().upper()
    filler = "".join(ch * 4 for ch in hexr[20:32]).encode()
    return (rb[:KEY_LEN] + BREAK_1 + f"{record_number:032X}".encode() + BREAK_2 +
            filler + BREAK_3)


def generate(spark: SparkSession, records: int, parts: int) -> DataFrame:
    """TS1: ``records`` records in ``parts`` partitions; partition i starts
    at record i*per_part and jumps the generator ahead to it, so the output
    does not depend on how many partitions produce it."""
    per = -(-records // parts)

    def gen(it):
        import pandas as pd
        for pdf in it:
            for i in pdf["id"].tolist():
                first = i * per
                n = max(0, min(per, records - first))
                x = skip_ahead(first)
                keys, vals = [], []
                for r in range(first, first + n):
                    x = (LCG_A * x + LCG_C) & MASK128
                    rec = make_record(x, r)
                    keys.append(rec[:KEY_LEN])
                    vals.append(rec[KEY_LEN:])
                yield pd.DataFrame({"key": keys, "value": vals})

    return (spark.range(0, parts, numPartitions=parts)
            .mapInPandas(gen, "key binary, value binary"))


def total_sort(df: DataFrame, parts: int | None = None, key: str = "key") -> DataFrame:
    """TS2 / SRT2: one range-partitioning shuffle (bounds sampled from the
    data), then a sort inside each partition; without ``parts`` the number of
    partitions follows the shuffle settings and AQE's partition size."""
    ranged = df.repartitionByRange(parts, F.col(key)) if parts else df.repartitionByRange(F.col(key))
    return ranged.sortWithinPartitions(key)


def range_bucket(key: Column, parts: int) -> Column:
    """TS3: partition of a key by its first 7 bytes read as an unsigned
    number, divided by (2^56 - 1) // parts; clamped so the top prefix never
    yields partition ``parts``."""
    step = ((1 << 56) - 1) // parts
    prefix = F.conv(F.hex(F.substring(key, 1, 7)), 16, 10).cast("long")
    return F.least(F.floor(prefix / F.lit(step)).cast("int"), F.lit(parts - 1))


def write_sorted(df: DataFrame, path: str, parts: int | None = None, key: str = "key") -> None:
    """TS2 / SNK2: the totally sorted table on disk, as Parquet with a ``part``
    column.  Every range partition is one task, and the writer numbers its
    files by task, so the order of the file names is the order of the keys;
    Spark's committer makes the files visible once the job is complete."""
    total_sort(df, parts, key).withColumn("part", F.spark_partition_id()).write.parquet(path)


def read_sorted(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that ``write_sorted`` made, with their place: ``file``
    (task and file number from the file's name) and ``row`` in it."""
    number = lambda pattern: F.lpad(F.regexp_extract("_metadata.file_name", pattern, 1), 12, "0")
    return spark.read.parquet(path).select("*", F.concat(number(r"^part-(\d+)"), number(r"-c(\d+)")).alias("file"),
                                           F.col("_metadata.row_index").alias("row"))


def validate(sorted_df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """TS4 on a DataFrame: one row ``(records, checksum, full_checksum,
    partitions, violations)``, each partition validated where it lies and its
    first key compared with the previous partition's last."""
    return _verdict(sorted_df.withColumns({"_run": F.format_string("%012d", F.spark_partition_id()), "_row": F.lit(None).cast("long"),
                                           "_part": F.lit(0)}), key, value)


def validate_files(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """TS4 on files: ``validate``'s row for the table under ``path``, with the
    order taken from the files on disk.  A task reads some splits of some
    files; every piece of a file that it meets is validated row by row, and
    the pieces are compared in the order of file name and row number: a piece
    must start where the last one of its file ended, its first key must not be
    smaller than the last key before it, and ``part`` must not fall."""
    return _verdict(read_sorted(spark, path).withColumns({"_run": F.col("file"), "_row": F.col("row"), "_part": F.col("part")}), key, value)


def _verdict(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Statistics of every run (rows of one ``_run`` that follow each other in
    a task; no shuffle): record count, sums of CRC-32, first and last key and
    row, and neighbours out of order, by Arrow batches (whole-column
    comparisons of neighbouring keys).  Then, one row per run: order across
    runs.  Sums are decimal(38,0), wide enough for any 128-bit total the
    benchmark can reach."""
    tagged = rows.select(
        F.col("_run").alias("run"), F.col("_row").alias("row"), F.col("_part").cast("long").alias("part"), F.col(key).alias("k"),
        F.crc32(F.col(key)).alias("crc"),
        F.crc32(F.concat(F.col(key), F.col(value))).alias("crc_full"))

    def per_run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        now = None  # run, first row, last row, records, sums, first and last key, violations, first and last part

        def out():
            names = ("run", "low", "high", "n", "sum", "sumf", "first", "last", "bad", "part_low", "part_high")
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            cells = [str(x) if n in ("sum", "sumf") else x for n, x in zip(names, now)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, kinds)], names=list(names))

        for b in batches:
            if not b.num_rows:
                continue
            run = b.column("run").dictionary_encode().indices.to_numpy()
            row = b.column("row").to_numpy(zero_copy_only=False)
            new = np.flatnonzero((run[1:] != run[:-1]) | (row[1:] < row[:-1])) + 1  # (null rows compare false)
            for low, high in zip([0, *new.tolist()], [*new.tolist(), b.num_rows]):
                p = b.slice(low, high - low)
                k, part = p.column("k"), p.column("part")
                name, first, at = p.column("run")[0].as_py(), k[0].as_py(), p.column("row")[0].as_py()
                if now is not None and (now[0] != name or (at is not None and at < now[2])):
                    yield out()
                    now = None
                if now is None:
                    now = [name, at, at, 0, 0, 0, first, first, 0, part[0].as_py(), part[0].as_py()]
                bad = pc.sum(pc.less(k.slice(1), k.slice(0, len(k) - 1))).as_py() or 0
                bad += pc.sum(pc.less(part.slice(1), part.slice(0, len(k) - 1))).as_py() or 0
                gap = lambda x, y: x is not None and y != x + 1
                if at is not None:
                    bad += int((np.diff(p.column("row").to_numpy()) != 1).sum())
                if now[3]:
                    bad += int(first < now[7]) + int(part[0].as_py() < now[10]) + int(gap(now[2], at))
                now[2], now[3] = p.column("row")[len(k) - 1].as_py(), now[3] + len(k)
                now[4] += pc.sum(p.column("crc")).as_py()
                now[5] += pc.sum(p.column("crc_full")).as_py()
                now[7], now[8], now[10] = k[len(k) - 1].as_py(), now[8] + bad, part[len(k) - 1].as_py()
        if now is not None:
            yield out()

    stats = tagged.mapInArrow(per_run, "run string, low long, high long, n long, sum string, sumf string, first binary, last binary, bad long, "
                                       "part_low long, part_high long")
    # one row per run from here on
    w = Window.orderBy("run", "low")
    before = lambda c: F.lag(c).over(w)
    place = F.when(before("run") == F.col("run"), F.col("low") != before("high") + 1).otherwise(F.col("low") > 0)
    cross = stats.withColumn("cross_bad", sum((F.coalesce(x, F.lit(False)).cast("int") for x in
                                               (before("last") > F.col("first"), before("part_high") > F.col("part_low"), place)), F.lit(0)))
    return cross.agg(
        F.sum("n").alias("records"),
        F.sum(F.col("sum").cast("decimal(38,0)")).alias("checksum"),
        F.sum(F.col("sumf").cast("decimal(38,0)")).alias("full_checksum"),
        F.count_distinct("run").alias("partitions"),
        (F.sum("bad") + F.sum("cross_bad")).alias("violations"))


def checksum(df: DataFrame, key: str = "key") -> DataFrame:
    """AGG20: records and sum of CRC-32 of the keys (order-free)."""
    return df.agg(F.count(F.lit(1)).alias("records"),
                  F.sum(F.crc32(F.col(key)).cast("decimal(38,0)")).alias("checksum"))
