"""Reader of fixed-width binary records (SRC13) as a Python Data Source.

Files hold back-to-back records of ``record_len`` bytes (default 100: a
10-byte key and a 90-byte value).  The reader lists the files in path
order and cuts each into splits of about ``split_bytes``, moved to record
boundaries, so every split is read by its own task; records are sliced
with numpy and handed to Spark as Arrow batches.  A file whose size is not
a whole number of records is an error (never a silently short record).
Sorted tables are written as Parquet (``operators.sortbench.write_sorted``).

Paths go through ``pyarrow.fs``, which resolves local paths and cluster
filesystems (HDFS, S3, ...) alike.

    register_records(spark)
    df = spark.read.format("fixedrecords").load(path)        # key, value
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "fixedrecords"


def _fs(path: str):
    """(filesystem, path inside it) for a local path, a ``file:`` URI or any
    cluster URI pyarrow knows (hdfs://, s3://, ...)."""
    from pyarrow import fs
    if path.startswith("file:"):
        local = path[len("file:"):]
        while local.startswith("//"):
            local = local[1:]
        return fs.LocalFileSystem(), local
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class _Split(InputPartition):
    path: str
    start: int
    length: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.rec = int(options.get("record_len", 100))
        self.key = int(options.get("key_len", 10))
        self.split = int(options.get("split_bytes", 64 << 20))

    def partitions(self):
        from pyarrow import fs as pafs
        filesystem, root = _fs(self.path)
        info = filesystem.get_file_info(root)
        if info.type == pafs.FileType.Directory:
            infos = filesystem.get_file_info(pafs.FileSelector(root, recursive=False))
            files = sorted((i for i in infos if i.type == pafs.FileType.File
                            and not i.base_name.startswith(("_", "."))), key=lambda i: i.path)
        else:
            files = [info]
        step = max(self.rec, self.split // self.rec * self.rec)
        out = []
        for f in files:
            if f.size % self.rec:
                raise ValueError(f"{f.path}: {f.size} bytes is not a whole number of "
                                 f"{self.rec}-byte records")
            for s in range(0, f.size, step):
                out.append(_Split(f.path, s, min(step, f.size - s)))
        return out or [_Split("", 0, 0)]

    def read(self, partition: _Split):
        import numpy as np
        import pyarrow as pa
        if partition.length == 0:
            return
        filesystem, _ = _fs(self.path)
        chunk = 1 << 16  # records per Arrow batch, at most
        with filesystem.open_input_file(partition.path) as f:
            f.seek(partition.start)
            left = partition.length
            while left > 0:
                n = min(left, chunk * self.rec)
                buf = f.read(n)
                if len(buf) != n:
                    raise IOError(f"{partition.path}: short read at {partition.start}")
                rows = np.frombuffer(buf, dtype=np.uint8).reshape(-1, self.rec)
                cnt = rows.shape[0]
                keys = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(self.key), cnt, [None, pa.py_buffer(np.ascontiguousarray(rows[:, :self.key]).tobytes())])
                vals = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(self.rec - self.key), cnt,
                    [None, pa.py_buffer(np.ascontiguousarray(rows[:, self.key:]).tobytes())])
                yield pa.RecordBatch.from_arrays([keys.cast(pa.binary()), vals.cast(pa.binary())],
                                                 names=["key", "value"])
                left -= n


class FixedRecords(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "key binary, value binary"

    def reader(self, schema):
        return _Reader(self.options)


def register_records(spark) -> None:
    spark.dataSource.register(FixedRecords)


def read_records(spark, path: str, **options):
    register_records(spark)
    r = spark.read.format(FORMAT)
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load(path)

