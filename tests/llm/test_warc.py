import base64
import gzip
import hashlib
import random

import pytest

from tessera.llm import warc as W


def want(rows):
    """The contract's law, row by row."""
    first = {}
    for p, h in rows:
        first.setdefault(h, []).append(p)
    low = {h: min((x for x in ps if x is not None), default=None) for h, ps in first.items()}
    out = []
    for p, h in rows:
        raw = h.encode()
        again = len(first[h]) > 1 and p != low[h]
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", low[h] if again else None))
    return sorted(out, key=str)


def nested():
    inner = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:999>\r\nContent-Length: 30\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" + b"y" * 11 + b"\r\n\r\n"
    return inner.decode()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i * 2, f"http://h/{i}", f"<p>{i}</p>" * (i % 40)) for i in range(120)]
    rows += [(501, None, None), (502, "u\r\nX: y", ""), (503, "u", "same é\n"), (504, "u", "same é\n"), (400, "u", "same é\n"), (400, "u", "same é\n"),
             (600, "u", nested() * 3), (601, "u", "WARC/1.1\r\nContent-Length: 9999999\r\n\r\nx"), (602, "u", "\r\n\r\n" + nested()),
             (603, "u", "x" * 300_000 + nested()), (604, "u", "WARC/1.1\r\n" * 500), (None, "u", "only null id"), (605, "u", nested()), (606, "u", nested())]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, size int").repartition(4)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip_equals_law(spark, pages):
    assert got(W.round_trip(pages)) == want([(r.page_id, r.html or "") for r in pages.collect()])


@pytest.mark.parametrize("block", [700, 100_000, 1 << 30])
def test_payloads_survive_whatever_the_blocks(spark, pages, tmp_path, block):
    path = str(tmp_path / "archives")
    W.write_archives(pages, path)
    back = W.read_archives(spark, path, payload=True, block=block).filter("record_type = 'response'").collect()
    html = {}
    for r in pages.collect():
        html.setdefault(r.page_id, (r.html or "").encode())
    assert len(back) > 100 and all(bytes(r.payload) == html[r.page_id] for r in back)
    assert not any(r.page_id == 999 for r in back)
    assert {r.url for r in back if r.page_id == 502} <= {"u%0D%0AX: y"}


def test_small_payloads_are_no_revisits(spark, pages):
    out = W.round_trip(pages, least=100).collect()
    assert all(r.payload_bytes >= 100 for r in out if r.record_type == "revisit") and any(r.record_type == "revisit" for r in out)


def test_chain_equals_sequential_reader(spark, pages, tmp_path):
    """The records kept are those of a reader that goes from start to end."""
    path = tmp_path / "archives"
    W.write_archives(pages, str(path))
    seq = []
    for f in path.glob("part-*"):
        data, at = gzip.decompress(f.read_bytes()), 0
        while at < len(data):
            seq.append((f.name, at))
            end, fields = W._parse(data, at)
            at = end + int(fields[b"content-length"]) + 4
    rows = W.read_archives(spark, str(path), block=2000).collect()
    assert sorted((r.archive.rsplit("/", 1)[-1], r.at) for r in rows) == sorted(seq)


def test_given_table_and_empty(spark):
    p = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert got(W.round_trip(p)) == want([(r.page_id, r.html or "") for r in p.collect()])
    assert W.round_trip(p.limit(0)).count() == 0


def test_headers_of_any_length(spark, tmp_path):
    """A record with a url of over 64 KB keeps its place in the chain."""
    rows = [(i, "data:," + "x" * 200_000 if i == 7 else f"http://h/{i}", f"<p>{i}</p>") for i in range(20)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert got(W.round_trip(p)) == want([(i, h) for i, _, h in rows])
    W.write_archives(p, str(tmp_path / "archives"))
    assert sorted((r.page_id, r.url) for r in W.read_archives(spark, str(tmp_path / "archives")).collect()) == [(i, u) for i, u, _ in rows]


@pytest.mark.parametrize("at", [0, 10])
def test_torn_archive_is_an_error(spark, tmp_path, at):
    W.write_archives(spark.range(20).selectExpr("id page_id", "'u' url", "string(id) html").coalesce(1), str(tmp_path / "archives"))
    f = next((tmp_path / "archives").glob("part-*"))
    data = gzip.decompress(f.read_bytes())
    starts = [m.start() for m in W._MAGIC.finditer(data)]
    (tmp_path / "torn").mkdir()
    (tmp_path / "torn" / "part-0").write_bytes(data[:starts[at]] + data[starts[at]:].replace(b"Content-Length: ", b"Content-Length: 9", 1))
    with pytest.raises(ValueError, match="part-0"):
        W.read_archives(spark, str(tmp_path / "torn"))


def test_places_inside_one_header_cost_linear_time():
    import time
    t = time.time()
    lines = b"A: WARC/1.1\r\n" * 100_000
    data = b"WARC/1.1\r\n" + lines + b"Content-Length: 2\r\n\r\nok\r\n\r\n"
    assert len(W.candidates(data)) == 100_001 and not W.candidates(b"WARC/1.1\r\n" + lines)
    assert W.candidates(b"WARC/1.1\r\nContent-Length: 2\r\nA: WARC/1.1\r\n\r\nok\r\n\r\n").keys() == {0}
    assert time.time() - t < 20


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    """Pages of up to several MB under a small bound: an archive over it holds
    one record."""
    rng = random.Random(8)
    rows = [(i, "u", chr(97 + i % 26) * rng.choice([3, 900, 20_000, 300_000, 5_000_000])) for i in range(160)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    bound = 1 << 20
    W.write_archives(p, str(tmp_path / "archives"), archive_bytes=bound)
    sizes = []
    for f in (tmp_path / "archives").glob("part-*"):
        data = gzip.decompress(f.read_bytes())
        n = len(W.candidates(data))
        sizes.append((len(data), n))
        assert len(data) <= bound or n == 1
    assert sum(n for _, n in sizes) == 160 and any(s > bound for s, _ in sizes) and any(n > 1 for _, n in sizes)
    assert got(W.round_trip(p, archive_bytes=bound)) == want([(i, h) for i, _, h in rows])


def test_ids_keep_their_type(spark, tmp_path):
    ids = ["a b", "null", "", "7", "x>\r\ny", "é%41", None]
    p = spark.createDataFrame([(x, "u", f"p{i}") for i, x in enumerate(ids)] + [("z", "u", "p0")], "page_id string, url string, html string")
    out = {r.page_id: r for r in W.round_trip(p).collect()}
    assert out.keys() == {*ids, "z"} and out["z"].refers_to == "a b" and out["z"].record_type == "revisit"
    W.write_archives(p, str(tmp_path / "archives"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cast"):
        W.read_archives(spark, str(tmp_path / "archives")).collect()
