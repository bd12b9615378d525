"""Run reporting: the event-log summary (SRC14, RPT2) and the run table
(RPT1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ntz_micros

# The subset of the listener event-log schema the summary reads.
EVENT_LOG_SCHEMA = T.StructType([
    T.StructField("Event", T.StringType()),
    T.StructField("Task Type", T.StringType()),
    T.StructField("Task Info", T.StructType([
        T.StructField("Stage ID", T.LongType()),
        T.StructField("Launch Time", T.LongType()),
        T.StructField("Finish Time", T.LongType())])),
    T.StructField("Task Metrics", T.StructType([
        T.StructField("Input Metrics", T.StructType([
            T.StructField("Data Read Method", T.StringType()),
            T.StructField("Bytes Read", T.LongType())])),
        T.StructField("Shuffle Read Metrics", T.StructType([
            T.StructField("Remote Bytes Read", T.LongType())])),
        T.StructField("Shuffle Write Metrics", T.StructType([
            T.StructField("Shuffle Bytes Written", T.LongType())]))])),
    T.StructField("Stage Info", T.StructType([
        T.StructField("Stage ID", T.LongType()),
        T.StructField("Submission Time", T.LongType()),
        T.StructField("Completion Time", T.LongType())])),
    T.StructField("Timestamp", T.LongType()),
])


def parse_event_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """SRC14: JSON lines → typed events (explicit schema, no inference)."""
    return lines.select(F.from_json(F.col(col), EVENT_LOG_SCHEMA).alias("e")).select("e.*")


def read_event_log(spark, path: str) -> DataFrame:
    return spark.read.schema(EVENT_LOG_SCHEMA).json(path)


def event_log_summary(ev: DataFrame) -> DataFrame:
    """RPT2: one row of totals over an application's event log: tasks (all,
    non-empty, shuffle-map vs result, their time), input bytes by read
    method, remote shuffle read, shuffle write, stage count and time, and
    the application's minutes."""
    task = F.col("Event") == "SparkListenerTaskEnd"
    stage = F.col("Event") == "SparkListenerStageCompleted"
    ti, tm = F.col("Task Info"), F.col("Task Metrics")
    dur = ti["Finish Time"] - ti["Launch Time"]
    ttype = F.col("Task Type")
    method = tm["Input Metrics"]["Data Read Method"]
    nbytes = tm["Input Metrics"]["Bytes Read"]
    si = F.col("Stage Info")

    def tsum(cond, v):
        return F.coalesce(F.sum(F.when(task & cond, v)), F.lit(0)).cast("long")

    return ev.agg(
        F.count_if(task).alias("tasks"),
        F.count_if(task & (dur > 0)).alias("tasks_nonempty"),
        F.count_if(task & (ttype == "ShuffleMapTask") & ti.isNotNull()).alias("shuffle_tasks"),
        F.count_if(task & (ttype == "ResultTask") & ti.isNotNull()).alias("result_tasks"),
        tsum(ttype == "ShuffleMapTask", dur).alias("shuffle_task_ms"),
        tsum(ttype == "ResultTask", dur).alias("result_task_ms"),
        tsum(method.isNotNull(), nbytes).alias("input_bytes"),
        tsum(method == "Hadoop", nbytes).alias("input_hadoop"),
        tsum(method == "Memory", nbytes).alias("input_memory"),
        tsum(method == "Disk", nbytes).alias("input_disk"),
        tsum(method == "Network", nbytes).alias("input_network"),
        tsum(F.lit(True), tm["Shuffle Read Metrics"]["Remote Bytes Read"]).alias("shuffle_read"),
        tsum(F.lit(True), tm["Shuffle Write Metrics"]["Shuffle Bytes Written"]).alias("shuffle_write"),
        F.count_if(stage).alias("stages"),
        F.coalesce(F.sum(F.when(stage, si["Completion Time"] - si["Submission Time"])), F.lit(0))
        .cast("long").alias("stage_ms"),
        F.floor((F.max(F.when(F.col("Event") == "SparkListenerApplicationEnd", F.col("Timestamp"))) -
                 F.max(F.when(F.col("Event") == "SparkListenerApplicationStart", F.col("Timestamp"))))
                / 60000).cast("long").alias("app_minutes"))


def run_report(runs: DataFrame) -> DataFrame:
    """RPT1: per run ``(type, start, duration_s, size_mb, throughput_mb_s,
    status)`` from ``(type, start, end, bytes, failed)`` rows."""
    micros = (lambda c: ntz_micros(c)) if dict(runs.dtypes).get("start") == "timestamp_ntz" \
        else (lambda c: F.unix_micros(F.col(c)))
    dur = (micros("end") - micros("start")) / 1e6
    size = F.col("bytes") / (1024.0 * 1024.0)
    return runs.select("type", "start", dur.alias("duration_s"), size.alias("size_mb"),
                       F.when(dur > 0, size / dur).alias("throughput_mb_s"),
                       F.when(F.col("failed"), "FAILED").otherwise("OK").alias("status"))


class PhaseTimer:
    """SNK7: wall-clock seconds of the phases of a job (``load``,
    ``training``, ``test``), reported as the reference's one-line JSON
    ``{"loadTime":..,"trainingTime":..,"testTime":..}`` or as a one-row
    DataFrame.  Each phase should end with an action, or it measures only
    plan construction."""

    def __init__(self):
        import time
        self._now = time.perf_counter
        self.times: dict[str, float] = {}

    def phase(self, name: str):
        timer = self

        class _Ctx:
            def __enter__(self):
                self.t0 = timer._now()

            def __exit__(self, *exc):
                timer.times[name] = round(timer._now() - self.t0, 3)
                return False
        return _Ctx()

    def json(self) -> str:
        import json
        return json.dumps({f"{k}Time": v for k, v in self.times.items()}, separators=(",", ":"))

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([tuple(self.times.values())],
                                     ", ".join(f"{k}_s double" for k in self.times))
