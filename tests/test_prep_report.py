import json

from support import rows
from tessera.functions.columns import java_hash_code
from tessera.operators import prep as P
from tessera.operators import report as R


def _jh(s):
    h = 0
    for ch in s:
        h = (31 * h + ord(ch)) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def test_review_blocks(spark, tmp_path):
    good = "\n".join(f"k{i}: v{i}" for i in range(8))
    seven = "\n".join(f"k{i}: v{i}" for i in range(7))
    noisy = "no colon line\n" + good
    text = good + "\n\n" + seven + "\n\n" + noisy  # last block has no trailing blank line
    p = tmp_path / "reviews.txt"
    p.write_text(text)
    blocks = spark.read.option("lineSep", "\n\n").text(str(p))
    out = [r["line"] for r in P.convert_reviews(blocks).collect()]
    line = f"{_jh('v0')}::{_jh('v1')}::v4::v5"
    assert out == [line, line]


def test_page_corpus_min_chars(spark):
    html = ('<html><head><title>T1</title></head><body><nav><ul><li><a href="/x">x</a></li>'
            '<li><a href="/y">y</a></li></ul></nav><article><p>Hello\nworld</p></article></body></html>')
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    got = P.page_corpus(pages, 5).first()["line"]
    assert got == ":x:y :::: T1 Hello world"
    assert P.page_corpus(pages, 500).count() == 0
    c = P.page_counters(pages, 5).first()
    assert (c["pages"], c["big_pages"], c["with_category"]) == (1, 1, 1)


def test_event_log_null_metrics_and_empty_tasks(spark):
    evs = [
        {"Event": "SparkListenerTaskEnd", "Task Type": "ResultTask",
         "Task Info": {"Stage ID": 0, "Launch Time": 10, "Finish Time": 10}},
        {"Event": "SparkListenerTaskEnd", "Task Type": "ShuffleMapTask",
         "Task Info": {"Stage ID": 0, "Launch Time": 10, "Finish Time": 30},
         "Task Metrics": {"Input Metrics": {"Data Read Method": "Hadoop", "Bytes Read": 7},
                          "Shuffle Write Metrics": {"Shuffle Bytes Written": 3}}},
        {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 0, "Submission Time": 5, "Completion Time": 65}},
        {"Event": "SparkListenerApplicationStart", "Timestamp": 0},
        {"Event": "SparkListenerApplicationEnd", "Timestamp": 180000},
    ]
    lines = spark.createDataFrame([(json.dumps(e),) for e in evs], "value string")
    s = R.event_log_summary(R.parse_event_log(lines)).first()
    assert s["tasks"] == 2 and s["tasks_nonempty"] == 1
    assert s["input_hadoop"] == 7 and s["shuffle_write"] == 3 and s["shuffle_read"] == 0
    assert s["stages"] == 1 and s["stage_ms"] == 60 and s["app_minutes"] == 3


def test_run_report(spark):
    runs = spark.createDataFrame([("a", "2024-01-01 00:00:00", "2024-01-01 00:00:10", 10 * 1024 * 1024, False)],
                                 "type string, start string, end string, bytes long, failed boolean")
    r = R.run_report(runs.selectExpr("type", "cast(start as timestamp) start", "cast(end as timestamp) end",
                                     "bytes", "failed")).first()
    assert r["duration_s"] == 10 and r["size_mb"] == 10 and r["throughput_mb_s"] == 1 and r["status"] == "OK"


def test_generators(spark):
    d = P.labeled_points(spark, 100, 5, seed=1)
    assert d.count() == 100 and set(rows(d.select("label").distinct())) <= {(0.0,), (1.0,)}
    v = P.page_views(spark, 1000)
    assert v.filter("user < 1 or user > 100").count() == 0


def test_review_blocks_by_one_expression(spark):
    """The compiled expression reads lines as trimming and splitting them does."""
    import random
    import re
    rng = random.Random(5)
    blocks = ["\n".join("".join(rng.choice("ab:  \t\r ") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(8, 14))) for _ in range(3000)]
    blocks += ["\n".join(f"k{i}: v:{i} \t  " for i in range(8)), "", None, "\n" + "\n\n".join(f" : {i}" for i in range(8)) + "\n"]

    def fields(block):
        lines = [x.strip(" ") for x in (block or "").split("\n")]
        return [m[1] for m in (re.split(r"[ \t\n\x0b\f\r]*:[ \t\n\x0b\f\r]*", x, maxsplit=1) for x in lines if x) if len(m) == 2]

    from tessera.operators.prep import convert_reviews
    df = convert_reviews(spark.createDataFrame([(b,) for b in blocks], "value string"))
    assert "lambda" not in df._jdf.queryExecution().toString()
    got = sorted(tuple(r.line.split("::", 2)[2:]) for r in df.collect())
    want = sorted((f"{f[4]}::{f[5]}",) for f in map(fields, blocks) if len(f) == 8)
    assert got == want and len(want) > 40
