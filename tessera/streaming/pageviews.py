"""Page-view stream metrics (ST1-ST6, ST14) on the ``events`` table.

Every builder takes an events DataFrame — batch *or* streaming — and
returns the aggregate, so the same code answers both (ST15).  Time is
event time (``events.ts``); windows align to the epoch as Spark's do.

Re-aim: url → ``event_type``, status 5xx → ``event_type = 'error'``,
zip code → ``user_id % 20``, user → ``user_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import instant_to_ntz, ntz_to_instant

ZIPS = 20


def event_time(df: DataFrame) -> DataFrame:
    """``ts`` is TIMESTAMP_NTZ; watermarks need TIMESTAMP.  The wall clock is
    read as UTC whatever the session time zone, so windows align to the
    epoch exactly as in the oracle."""
    return df.withColumn("et", ntz_to_instant("ts"))


def _window_cols():
    return [instant_to_ntz(F.col("window.start")).alias("w_start"),
            instant_to_ntz(F.col("window.end")).alias("w_end")]


def page_counts(events: DataFrame) -> DataFrame:
    """ST1: count by value of the page (event type)."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def sliding_counts(events: DataFrame, length: str = "10 days", slide: str = "2 days",
                   watermark: str | None = None) -> DataFrame:
    """ST2 (+ST14 when ``watermark`` is set): counts per sliding window and
    page.  With a watermark, append mode emits each window once it is closed
    and its state is dropped."""
    e = event_time(events)
    if watermark:
        e = e.withWatermark("et", watermark)
    a = e.groupBy(F.window("et", length, slide), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return a.select(*_window_cols(), "event_type", "n")


def error_rate_per_zip(events: DataFrame, length: str = "30 days", slide: str = "2 days",
                       threshold: float = 0.05, watermark: str | None = None) -> DataFrame:
    """ST3: share of error events per zip code and window, flagged above
    ``threshold`` (the reference marks those lines with ``**``)."""
    e = event_time(events)
    if watermark:
        e = e.withWatermark("et", watermark)
    e = e.withColumn("zip", F.pmod("user_id", F.lit(ZIPS)))
    a = e.groupBy(F.window("et", length, slide), "zip").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("event_type") == "error").alias("errors"))
    return a.select(*_window_cols(), "zip", "n", "errors",
                    (F.col("errors") / F.col("n")).alias("ratio"),
                    ((F.col("errors") / F.col("n")) > threshold).alias("flag"))


def active_users(events: DataFrame, length: str = "15 days", slide: str = "2 days",
                 watermark: str | None = None) -> DataFrame:
    """ST4: distinct users per sliding window, exact.  Streams dedupe
    (window, user) in keyed state and count the survivors — a chained
    stateful plan that never gathers a window's users into one row.  With a
    watermark, append mode emits a window once it is closed and drops the
    state of its users, so the state holds the open windows alone."""
    e = event_time(events)
    if watermark:
        e = e.withWatermark("et", watermark)
    d = (e.select(F.window("et", length, slide).alias("window"), "user_id")
         .dropDuplicates(["window", "user_id"]))
    a = d.groupBy("window").agg(F.count(F.lit(1)).alias("users"))
    return a.select(*_window_cols(), "users")


def closing_events(events: DataFrame, after_days: int = 400) -> DataFrame:
    """Two rows, far behind the last event and a day apart, that close every
    window of ``events`` when they arrive last: the first moves the watermark,
    the second lets the stream run once more with it.  Their own windows stay
    open, so they are never in an append-mode result."""
    last = events.agg(F.max("ts").alias("ts"))
    rows = last.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "ts").filter("ts is not null")
    return rows.select(*(((F.col("ts") + F.make_dt_interval(F.col("k") + after_days)) if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name)
                         for f in events.schema.fields), "k")


def popular_users(events: DataFrame, users: DataFrame) -> DataFrame:
    """ST5: events joined with a static user table (stream–static join),
    counted per user name."""
    j = events.join(users.select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id")
    return j.groupBy("c_name").agg(F.count(F.lit(1)).alias("n"))


def marked(ratio: str = "ratio", threshold: float = 0.05, fmt: str = "%.4f"):
    """FN12: the ratio as text, wrapped in ``**`` when above ``threshold``
    (how the reference highlights zip codes with too many errors)."""
    r = F.col(ratio)
    txt = F.format_string(fmt, r)
    return F.when(r > threshold, F.concat(F.lit("**"), txt, F.lit("**"))).otherwise(txt)


# The metric names of the stream's command line.
METRICS = {
    "pageCounts": page_counts,
    "slidingPageCounts": sliding_counts,
    "errorRatePerZipCode": error_rate_per_zip,
    "activeUserCount": active_users,
    "popularUsersSeen": popular_users,
}


def metric(name: str):
    """ST6: metric builder by name; unknown names are an error."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; choose one of {sorted(METRICS)}")
    return METRICS[name]
