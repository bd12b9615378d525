"""WARC archives, written by Spark and read back by boundary-chain
verification (operator 5).

Writing: every page becomes one WARC/1.1 record.  Of pages with equal payloads
of at least ``least`` bytes the one with the smallest id is a response and the
others are revisits without a payload.  Records are built by column expressions
and written by the text sink in gzip-compressed archives of at most
``ARCHIVE_BYTES`` uncompressed: records are written in a few classes of size,
each with as many records an archive as its largest ones allow, and records
over ``ARCHIVE_BYTES`` have archives of their own.

Reading: a task holds one archive at a time (so at most ``ARCHIVE_BYTES``, or
one larger record) and finds every place that looks like a record
(the magic, a header, a length, a proper end); payloads may hold such places
too.  Each is an edge to the place after its end.  An archive is divided into
blocks; the task follows the edges inside a block from every place where a
chain can enter it and reports (entry, exit).  Pointer jumping over these pairs,
starting at offset 0 of every archive, finds the entries that a reader from the
file's start would meet; only the records on their chains are kept.

Edge cases: a null payload is empty, a null URL leaves out its header, line
breaks in URLs are percent-encoded; ids are written as text, percent-encoded,
and read back as the type asked for (an id that is none is an error); a null
page id is written as such and read back as null, and counts as the largest; rows with the same smallest id and
payload are all responses; headers may have any length; an archive whose chain
does not end at its last byte is an error; an empty table gives no rows; other
input columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from itertools import batched
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.iterate import cut, cut_to_table
from ..session import scratch_path
from . import textops as T

ARCHIVE_BYTES = 64 << 20  # uncompressed bytes of an archive
RECORDS_PER_ARCHIVE = 4096  # of the smallest records
BLOCK = 1 << 20  # bytes of an archive that a task follows as one piece of chain
DATE = "1970-01-01T00:00:00Z"

_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_FIELD = re.compile(rb"([A-Za-z0-9-]++):[ \t]*+([^\r\n]*+)\r\n")
_URN, _NO_ID = "urn:x-page:", "urn:x-no-page"
# Digits of conv() in base 32 and of the base32 alphabet.
_CONV = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: Column) -> Column:
    h = F.sha1(payload)
    return F.concat(*(F.translate(F.lpad(F.conv(F.substring(h, 10 * i + 1, 10), 16, 32), 8, "0"), _CONV, _BASE32) for i in range(4)))


def with_revisits(pages: DataFrame, least: int = 0, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, html, digest, size, refers_to (null for responses)."""
    html = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    src = (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
           .withColumn("digest", sha1_base32(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html").cast("long")))
    slim = src.select("page_id", "digest", "size")
    # written out, so that the join below has a plain table on this side and a
    # payload with very many copies can be split
    firsts = cut_to_table(slim.filter(F.col("size") >= least).groupBy("digest", "size")
                          .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    again = (slim.join(firsts, ["digest", "size"]).filter(~F.col("page_id").eqNullSafe(F.col("first")))
             .select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("size").alias("_size"), F.col("first").alias("refers_to"))
             .distinct())
    return (src.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")) & (F.col("size") == F.col("_size")), "left")
            .drop("_id", "_digest", "_size"))


def record_text() -> Column:
    """One record over the columns of ``with_revisits``, short of its last
    line break."""
    urn = lambda c: F.coalesce(F.concat(F.lit(f"<{_URN}"), F.url_encode(F.col(c).cast("string")), F.lit(">\r\n")), F.lit(f"<{_NO_ID}>\r\n"))
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), urn("page_id"), F.lit(f"WARC-Date: {DATE}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")),
        F.when(again, F.concat(F.lit(f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), urn("refers_to"))).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("size"))).cast("string"),
        F.lit("\r\n\r\n"), http, F.when(again, F.lit("")).otherwise(F.col("html")), F.lit("\r\n"))


def size_class(archive_bytes: int, url: str = "url", payload: str = "html") -> Column:
    """0 to 3 by a record's largest possible size: class k holds records up to
    archive_bytes / 4096 * 16**k bytes, the last one all larger ones too."""
    size = F.coalesce(F.octet_length(F.col(payload).cast("string")), F.lit(0)).cast("long") + 3 * F.coalesce(F.octet_length(F.col(url).cast("string")), F.lit(0)).cast("long") + 1024
    out = F.lit(3)
    for k in (2, 1, 0):
        out = F.when(size <= archive_bytes // RECORDS_PER_ARCHIVE * 16**k, F.lit(k)).otherwise(out)
    return out


def write_archives(pages: DataFrame, path: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES,
                   id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> None:
    """Write a WARC record per page into archives under ``path``."""
    classes = [r.k for r in pages.select(size_class(archive_bytes, url_col, payload_col).alias("k")).distinct().orderBy("k").collect()] or [0]
    records = with_revisits(pages, least, id_col, payload_col, url_col)
    for k in classes:
        own = records if len(classes) == 1 else records.filter(size_class(archive_bytes) == k)
        (own.select(record_text().alias("value")).write.mode("error" if k == classes[0] else "append")
         .option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, RECORDS_PER_ARCHIVE >> 4 * k)).text(path))


def _parse(data: bytes, at: int):
    """(end of header, fields) of the record that seems to start at ``at``."""
    m = _MAGIC.match(data, at)
    pos, fields = m.end(), {}
    while data[pos:pos + 2] != b"\r\n":
        f = _FIELD.match(data, pos)
        if not f:
            return None
        fields[f[1].lower()] = f[2]
        pos = f.end()
    return pos + 2, fields


def candidates(data: bytes) -> dict[int, tuple[int, int]]:
    """offset -> (successor's offset, offset of the block) for each place that
    looks like a whole record: followed by the end of the archive or by another
    magic.  Places inside one header share its lines, which are read once."""
    out = {}
    known: dict[int, tuple | None] = {}  # line of a header -> (its end, last length's line and value)
    for m in _MAGIC.finditer(data):
        if m.end() not in known:
            lines, pos, length = [m.end()], m.end(), (-1, b"")
            while f := _FIELD.match(data, pos):
                if f[1].lower() == b"content-length":
                    length = (pos, f[2])
                pos = f.end()
                lines.append(pos)
            known.update(dict.fromkeys(lines, (pos + 2, *length) if data[pos:pos + 2] == b"\r\n" else None))
        got = known[m.end()]
        if got and got[1] >= m.end() and got[2].isdigit() and len(got[2]) < 19:
            end = got[0] + int(got[2])
            if data[end:end + 4] == b"\r\n\r\n" and (end + 4 == len(data) or _MAGIC.match(data, end + 4)):
                out[m.start()] = (end + 4, got[0])
    return out


def _row(data: bytes, at: int, places: dict, keep_payload: bool):
    end, block = places[at]
    f = _parse(data, at)[1]
    ident = lambda x: unquote_plus(x[1 + len(_URN):-1].decode()) if x and x.startswith(f"<{_URN}".encode()) else None
    kind = f.get(b"warc-type", b"").decode("ascii", "replace")
    split = data.find(b"\r\n\r\n", block, end - 4)
    payload = data[split + 4:end - 4] if split >= 0 else b""
    if kind == "revisit":
        inner = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)\r\n", data[block:split + 4])
        size, digest = int(inner[1]) if inner else None, f.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return (at, ident(f.get(b"warc-record-id")), f.get(b"warc-target-uri", b"").decode("utf-8", "replace") or None, kind, size, digest,
            ident(f.get(b"warc-refers-to")), payload if keep_payload else None)


_COLUMNS = "archive string, entry long, leave long, at long, page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def _follow(data: bytes, keep_payload: bool, block: int):
    """Rows of every chain piece: from each place where a chain can enter a
    block to where it leaves it; the piece's last row names the exit.  The
    archive's end is a piece without a record that leads to itself."""
    places = candidates(data)
    entries = {0} | {n for at, (n, *_) in places.items() if n // block != at // block}
    for entry in sorted(entries & places.keys()):
        at = entry
        while True:
            nxt = places[at][0]
            last = nxt // block != entry // block or nxt not in places
            yield (entry, nxt if last else None, *_row(data, at, places, keep_payload))
            if last:
                break
            at = nxt
    yield (len(data), len(data), *[None] * 8)


def reachable(edges: DataFrame) -> DataFrame:
    """(archive, entry) of the chain pieces met from offset 0, by pointer
    jumping: each round doubles the distance that a pointer spans, so rounds
    grow with the logarithm of an archive's blocks."""
    jump = cut(edges.select("archive", F.col("entry").alias("a"), F.col("leave").alias("b")))
    seen = cut(jump.filter("a = 0").select("archive", F.col("a").alias("entry")))
    n = seen.count()
    while n:
        far = jump.select("archive", F.col("a").alias("entry"), "b")
        step = seen.join(far, ["archive", "entry"]).select("archive", F.col("b").alias("entry"))
        starts = edges.select("archive", "entry")
        seen = cut(seen.union(step.join(starts, ["archive", "entry"], "left_semi")).distinct())
        more = seen.count()
        if more == n:
            break
        n = more
        ahead = jump.select(F.col("archive").alias("_f"), F.col("a").alias("_a"), F.col("b").alias("_b"))
        jump = cut(jump.join(ahead, (F.col("archive") == F.col("_f")) & (F.col("b") == F.col("_a"))).select("archive", "a", F.col("_b").alias("b")))
    return seen


def read_archives(spark: SparkSession, path: str, payload: bool = False, block: int = BLOCK, id_type: str = "long") -> DataFrame:
    """The records of all archives under ``path``: archive, at, page_id, url,
    record_type, payload_bytes, payload_digest (of the payload read, or the
    header's for revisits), refers_to and, if asked for, the payload.  An
    archive that cannot be followed to its end is an error, and so is an id
    that is no ``id_type``."""
    names = [c.split()[0] for c in _COLUMNS.split(", ")]

    def scan(batches):
        for b in batches:
            for name, raw in zip(b.column("path"), b.column("content")):
                data = gzip.decompress(raw.as_py()) if name.as_py().endswith(".gz") else raw.as_py()
                for rows in batched(_follow(data, payload, block), 256 if payload else 1000):
                    cols = list(zip(*rows))
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                    yield T.batch(names, [pa.array([name.as_py()] * len(cols[0]), pa.string()), *(pa.array(c, t) for c, t in zip(cols, types))])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*part-*").load(path).select("path", "content")
    rows = cut_to_table(files.mapInArrow(scan, _COLUMNS))
    good = reachable(rows.filter("leave is not null").select("archive", "entry", "leave"))
    torn = rows.filter("at is null").join(good, ["archive", "entry"], "left_anti").select("archive").limit(5).collect()
    if torn:
        raise ValueError(f"records do not lead to the end of {', '.join(r.archive for r in torn)}")
    kept = rows.filter("at is not null").join(good, ["archive", "entry"], "left_semi").drop("entry", "leave", *([] if payload else ["payload"]))
    return kept.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, least, archive_bytes)
    return read_archives(spark, path, id_type=pages.schema["page_id"].dataType.simpleString()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
