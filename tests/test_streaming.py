import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from support import SF_SMALL, rows
from tessera.sources.tables import load
from tessera.streaming import pageviews as PV
from tessera.streaming import words as W
from tessera.streaming.runner import dir_stream, run_to_table


@pytest.fixture(scope="module")
def event_dir(spark, tmp_path_factory):
    """The small events table cut into 4 files in time order."""
    d = str(tmp_path_factory.mktemp("events"))
    ev = load(spark, SF_SMALL, "events")
    n = ev.count()
    for i in range(4):
        part = ev.filter((F.col("event_id") >= i * n // 4) & (F.col("event_id") < (i + 1) * n // 4))
        part.coalesce(1).write.parquet(os.path.join(d, f"f{i}"))
    return d, ev.schema


def _stream(spark, event_dir):
    d, schema = event_dir
    return dir_stream(spark, d + "/*", schema, max_files_per_trigger=1)


def test_batch_stream_parity(spark, event_dir):
    ev = load(spark, SF_SMALL, "events")
    for build in (PV.sliding_counts, PV.error_rate_per_zip, PV.active_users, PV.page_counts):
        s = run_to_table(build(_stream(spark, event_dir)), "complete")
        b = build(ev)
        assert rows(s) == rows(b.select(*s.columns)), build.__name__


def test_append_mode_only_closed_windows(spark, event_dir):
    s = run_to_table(PV.sliding_counts(_stream(spark, event_dir), watermark="1 day"), "append")
    ev = load(spark, SF_SMALL, "events")
    mx = ev.agg(F.max("ts")).first()[0]
    b = PV.sliding_counts(ev).filter(F.col("w_end") <= F.lit(mx - dt.timedelta(days=1)))
    assert rows(s) == rows(b.select(*s.columns))


def test_late_rows_dropped_in_append_mode(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    d = str(tmp_path / "late")
    mk = lambda rows_: spark.createDataFrame(rows_, schema)
    t = lambda day: dt.datetime(2024, 1, day)
    # late rows are judged against the previous batch's watermark, so the
    # late row comes in the third file
    import time
    mk([(0, t(1), 1, "view", 1.0, "{}"), (1, t(20), 1, "view", 1.0, "{}")]).coalesce(1).write.parquet(d + "/a")
    time.sleep(1.1)
    mk([(2, t(25), 1, "view", 1.0, "{}")]).coalesce(1).write.parquet(d + "/b")
    time.sleep(1.1)
    mk([(3, t(2), 1, "view", 1.0, "{}"), (4, t(29), 1, "view", 1.0, "{}")]).coalesce(1).write.parquet(d + "/c")
    s = dir_stream(spark, d + "/*", mk([]).schema, max_files_per_trigger=1)
    out = run_to_table(PV.sliding_counts(s, "1 day", "1 day", watermark="1 day"), "append")
    got = {(r["w_start"].day, r["n"]) for r in out.collect()}
    assert (1, 1) in got and (20, 1) in got
    assert all(day != 2 for day, _ in got)            # the late row is absent ...
    batch = PV.sliding_counts(spark.read.parquet(d + "/*"), "1 day", "1 day")
    assert batch.filter(F.dayofmonth("w_start") == 2).count() == 1   # ... but in the batch answer


def test_per_batch_callback(spark, event_dir):
    out = run_to_table(_stream(spark, event_dir), per_batch=lambda b, e: PV.page_counts(b))
    assert out.select("batch").distinct().count() == 4
    tot = dict(rows(out.groupBy("event_type").agg(F.sum("n"))))
    assert tot == dict(rows(PV.page_counts(load(spark, SF_SMALL, "events"))))


def test_metric_dispatch():
    assert PV.metric("pageCounts") is PV.page_counts
    with pytest.raises(ValueError):
        PV.metric("nope")


def test_sketches_bounds(spark, event_dir):
    ev = load(spark, SF_SMALL, "events")
    exact = ev.select("user_id").distinct().count()
    est = run_to_table(W.distinct_hll(_stream(spark, event_dir), "user_id"), "complete").first()[0]
    assert abs(est - exact) <= max(2, 0.05 * exact)
    top = run_to_table(W.approx_heavy_hitters(_stream(spark, event_dir), "user_id", 3), "complete").first()[0]
    want = rows(W.key_counts(ev, "user_id").orderBy(F.col("n").desc(), "user_id").limit(3))
    assert [(t["item"], t["count"]) for t in top][:1] == [max(want, key=lambda x: (x[1], -x[0]))]
    cms = run_to_table(W.count_min(_stream(spark, event_dir), "user_id"), "complete").first()[0]
    assert len(cms) > 0


def test_running_counts_with_seed(spark):
    docs = spark.createDataFrame([("view view\nview",), (" a ",)], "text string")
    seed = spark.createDataFrame([("view", 1), ("hello", 1)], "word string, n long")
    assert dict(rows(W.running_counts(docs, seed))) == {"view": 4, "a": 1, "hello": 1}


def test_grep_union(spark):
    docs = load(spark, SF_SMALL, "documents")
    a = docs.filter(F.col("lang") == "en")
    b = docs.filter(F.col("lang") != "en")
    n = W.grep_count([a, b], "text", "the").first()[0]
    assert n == docs.filter(F.col("text").contains("the")).count()


def test_streaming_sgd_resumes(spark, tmp_path):
    from tessera.streaming.online import streaming_sgd
    d = str(tmp_path / "pts")
    import time
    rows_ = [(1.0, [1.0, 0.5]), (0.0, [1.0, -0.5])]
    for i in range(3):
        spark.createDataFrame(rows_ * (i + 1), "label double, features array<double>").coalesce(1) \
            .write.parquet(f"{d}/f{i}")
        time.sleep(1.1)
    schema = "label double, features array<double>"

    def stream(n):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/*")

    state = str(tmp_path / "state")
    w_full, _ = streaming_sgd(stream(3), 2, num_iter=2, state_dir=state)
    # a second run on the same state folder finds every batch committed
    w_again, _ = streaming_sgd(stream(3), 2, num_iter=2, state_dir=state)
    assert rows(w_full) == rows(w_again)
    w_fresh, _ = streaming_sgd(stream(3), 2, num_iter=2)
    assert rows(w_full) == rows(w_fresh)


def test_update_mode_equals_complete(spark, event_dir):
    u = run_to_table(PV.sliding_counts(_stream(spark, event_dir)), "update", keys=["w_start", "w_end", "event_type"])
    c = run_to_table(PV.sliding_counts(_stream(spark, event_dir)), "complete")
    assert rows(u) == rows(c.select(*u.columns))


@pytest.fixture(scope="module")
def folder_tables(spark, tmp_path_factory):
    """The shared tables with events and documents as folders of three files,
    written in time order."""
    import os
    root = tmp_path_factory.mktemp("folders")
    for name in os.listdir("/root/testdata/sf0.001"):
        if name not in ("events.parquet", "documents.parquet"):
            (root / name).symlink_to(f"/root/testdata/sf0.001/{name}")
    for name, key in (("events", "event_id"), ("documents", "doc_id")):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartitionByRange(3, key).sortWithinPartitions(key).cache()
        for i in range(3):
            part = df.filter(F.spark_partition_id() == i).coalesce(1)
            part.write.mode("append").parquet(str(root / f"{name}.parquet"))
        df.unpersist()
    return str(root)


def test_streams_over_folders_in_several_batches(spark, folder_tables, monkeypatch):
    """Every registered table stream gives the single-file answer on a folder
    read one file a micro-batch."""
    import functools

    from tessera.plans import stream_queries as S
    names = [n for n in S.Q if n != "st_logreg"]  # its batches are years, whatever the files
    assert len(names) >= 13
    want = {n: rows(S.Q[n](spark, "/root/testdata/sf0.001")) for n in names}
    monkeypatch.setattr(S, "table_stream", functools.partial(S.table_stream, max_files_per_trigger=1))
    for n in names:
        got = rows(S.Q[n](spark, folder_tables))
        assert got == want[n] and got, n


def test_missing_table_and_empty_folder_are_errors(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from tessera.streaming.runner import dir_stream, run_to_table, table_stream
    with pytest.raises(AnalysisException):
        table_stream(spark, str(tmp_path), "events")
    (tmp_path / "in").mkdir()
    with pytest.raises(RuntimeError, match="no input"):
        run_to_table(dir_stream(spark, str(tmp_path / "in"), "a int"), "append")


def test_unreadable_weights_are_an_error(spark, tmp_path):
    from tessera.streaming.online import _last_weights
    assert _last_weights(spark, str(tmp_path)) == (None, -1)
    bad = tmp_path / "weights" / "b000000000"
    bad.mkdir(parents=True)
    (bad / "part-0.parquet").write_bytes(b"not parquet at all")
    with pytest.raises(Exception):
        _last_weights(spark, str(tmp_path))


def test_active_users_drop_the_state_of_closed_windows(spark):
    """Several batches in time order: the answer is the batch answer, and the
    state rows fall once windows close."""
    from tessera.plans.stream_queries import ntz_micros
    from tessera.streaming.runner import arrivals_by, watch
    ev = load(spark, SF_SMALL, "events").select("ts", "user_id")
    want = rows(PV.active_users(ev))
    end = PV.closing_events(ev)
    slices = ev.withColumn("slice", F.floor(ntz_micros("ts") / 86_400_000_000 / 5).cast("int")).unionByName(
        end.select("ts", "user_id", (F.lit(1 << 30) + F.col("k")).alias("slice")))
    folder, schema, arrivals = arrivals_by(slices, "slice")
    assert len(arrivals) >= 6
    got, sizes = [], []
    q = (PV.active_users(watch(spark, folder, schema), length="4 days", slide="2 days", watermark="1 day").writeStream.outputMode("append")
         .foreachBatch(lambda b, _: got.extend(map(tuple, b.collect()))).start())
    try:
        for arrive in arrivals:
            arrive()
            q.processAllAvailable()
            sizes.append(sum(op["numRowsTotal"] for op in q.lastProgress["stateOperators"]))
    finally:
        q.stop()
    assert sorted(got) == rows(PV.active_users(ev, length="4 days", slide="2 days")) and len(got) == len(set(r[0] for r in got))
    assert sizes[-1] < max(sizes) / 3 and want


def test_one_training_stream_restarted_in_the_middle(spark, tmp_path):
    from tessera.streaming.online import streaming_sgd
    from tessera.streaming.runner import arrivals_by, watch
    pts = spark.range(400).selectExpr("cast(id % 7 > 3 as double) label", "array(1.0D, cast(id % 7 as double) / 7) features", "cast(1990 + id % 5 as int) year")

    def run(stops, state):
        folder, schema, arrivals = arrivals_by(pts, "year")
        for low, high in zip([0, *stops], [*stops, len(arrivals)]):
            w, _ = streaming_sgd(watch(spark, folder, schema), 2, num_iter=2, state_dir=state, arrivals=arrivals[low:high])
        return rows(w)

    whole = run([], str(tmp_path / "a"))
    assert run([2], str(tmp_path / "b")) == whole == run([1, 4], str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "a" / "weights" / "*")).count() == 5
    from tessera.operators.learn import sgd
    w = [0.0, 0.0]
    for y in range(1990, 1995):
        w = sgd(pts.filter(F.col("year") == y), "logistic", 2, 2, step=0.1, w0=w)
    assert [r[1] for r in whole] == pytest.approx(w)
