"""Registered streaming queries: each reads a table as a file stream, runs
to completion with ``availableNow`` and returns the result table.  SQL
oracles give the batch answer (complete mode equals batch; append mode
keeps only windows closed by the watermark)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ntz_micros
from ..operators.relational import top_n_per_group
from ..session import scratch_path
from ..sources.tables import Tables
from ..streaming import pageviews as PV
from ..streaming import words as W
from ..streaming.runner import arrivals_by, dir_stream, run_to_table, table_stream, watch

Q = {}
SQL = {}


def register(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# Queries in update mode set no watermark: files of a folder may arrive in any
# order of event time, and no row may be too late.  Their state is a counter per
# window and key; the queries in append mode drop closed windows.


def _events(spark, sf):
    return table_stream(spark, sf, "events")


def _windows_sql(length_days: int, slide_days: int, key_expr: str, key: str, aggs: str,
                 where: str = "true") -> str:
    """Sliding windows in SQL: every event belongs to the windows starting
    at the epoch-aligned slide boundaries within ``length`` before it."""
    k = -(-length_days // slide_days)
    return f"""with e as (select *, {key_expr} {key},
    time_bucket(interval '{slide_days} days', ts, timestamp '1970-01-01') b from events where {where}),
  x as (select *, b - to_days(cast({slide_days} * k as integer)) w_start from e, range({k}) t(k)),
  y as (select * from x where ts < w_start + to_days({length_days}))
select w_start, w_start + to_days({length_days}) w_end, {key}, {aggs} from y group by w_start, {key}"""


@register("st_page_counts", "select event_type, count(*) n from events group by event_type")
def st_page_counts(spark, sf):
    return run_to_table(PV.page_counts(_events(spark, sf)), "complete")


@register("st_sliding", _windows_sql(10, 2, "event_type", "event_type", "count(*) n"))
def st_sliding(spark, sf):
    return run_to_table(PV.sliding_counts(_events(spark, sf)), "update", keys=["w_start", "w_end", "event_type"])


@register("st_sliding_append", "with m as (select max(ts) mx from events), r as (" +
          _windows_sql(10, 2, "event_type", "event_type", "count(*) n") +
          ") select r.* from r, m where r.w_end <= m.mx - interval 1 day")
def st_sliding_append(spark, sf):
    return run_to_table(PV.sliding_counts(_events(spark, sf), watermark="1 day"), "append")


@register("st_error_rate", _windows_sql(
    30, 2, "user_id % 20", "zip",
    "count(*) n, count(*) filter (where event_type = 'error') errors, "
    "count(*) filter (where event_type = 'error') / count(*) ratio, "
    "count(*) filter (where event_type = 'error') / count(*) > 0.05 flag"))
def st_error_rate(spark, sf):
    return run_to_table(PV.error_rate_per_zip(_events(spark, sf)), "update", keys=["w_start", "w_end", "zip"])


@register("st_active_users", """with e as (select *, time_bucket(interval '2 days', ts, timestamp '1970-01-01') b from events),
  x as (select *, b - to_days(cast(2 * k as integer)) w_start from e, range(8) t(k)),
  y as (select * from x where ts < w_start + to_days(15))
select w_start, w_start + to_days(15) w_end, count(distinct user_id) users from y group by w_start""")
def st_active_users(spark, sf):
    """ST4: the events arrive in slices of 15 days, in order, and two closing
    rows at last; each window is emitted once and its state goes."""
    e = Tables(spark, sf).events.select("ts", "user_id")
    day = F.floor(ntz_micros("ts") / 86_400_000_000)
    end = PV.closing_events(e)
    slices = e.withColumn("slice", F.floor(day / 15).cast("int")).unionByName(
        end.select("ts", "user_id", (F.lit(1 << 30) + F.col("k")).alias("slice")))
    folder, schema, arrivals = arrivals_by(slices, "slice")
    return run_to_table(PV.active_users(watch(spark, folder, schema), watermark="1 day"), "append", arrivals=arrivals)


@register("st_popular_users", """select c_name, count(*) n from events join customer on c_custkey = user_id
group by c_name""")
def st_popular_users(spark, sf):
    return run_to_table(PV.popular_users(_events(spark, sf), Tables(spark, sf).customer), "update",
                        keys=["c_name"])


_WORDS_SQL = r"""with w as (select unnest(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+')) word from documents)
select word, count(*) n from w where length(word) > 0 group by word"""


@register("st_word_count", _WORDS_SQL)
def st_word_count(spark, sf):
    return run_to_table(W.word_counts(table_stream(spark, sf, "documents")), "update", keys=["word"])


# Initial state of the running word count example.
SEED = [("hello", 1), ("world", 1)]


@register("st_running_words", "with c as (" + _WORDS_SQL + "), s as (select * from (values " +
          ", ".join(f"('{w}', {n})" for w, n in SEED) +
          ") v(word, n)) select word, sum(n)::bigint n from (select * from c union all select * from s) u group by word")
def st_running_words(spark, sf):
    path = scratch_path(spark, "seed")
    seed = spark.createDataFrame(SEED, "word string, n long")
    seed.write.parquet(path)
    docs = table_stream(spark, sf, "documents")
    return run_to_table(W.running_counts(docs, dir_stream(spark, path, seed.schema)), "update", keys=["word"])


@register("st_mod10", "select event_id % 10 bucket, count(*) n from events group by 1")
def st_mod10(spark, sf):
    return run_to_table(W.mod_buckets(_events(spark, sf), "event_id"), "complete")


@register("st_grep", "select count(*) n from documents where contains(text, 'the')")
def st_grep(spark, sf):
    """ST10: two streams over the documents (English / other languages),
    merged, filtered, counted."""
    d1 = table_stream(spark, sf, "documents").filter(F.col("lang") == "en")
    d2 = table_stream(spark, sf, "documents").filter((F.col("lang") != "en") | F.col("lang").isNull())
    return run_to_table(W.grep_count([d1, d2], "text", "the"), "complete")


@register("st_heavy_hitters", """select user_id, n, rank from (select user_id, n,
  row_number() over (order by n desc, user_id) rank from (select user_id, count(*) n from events group by user_id) a) b
where rank <= 10""")
def st_heavy_hitters(spark, sf):
    c = run_to_table(W.key_counts(_events(spark, sf), "user_id"), "update", keys=["user_id"])
    top = c.orderBy(F.col("n").desc(), "user_id").limit(10)
    return top_n_per_group(top.withColumn("g", F.lit(0)), ["g"],
                           [F.col("n").desc(), F.col("user_id")], 10).drop("g")


@register("st_distinct_users", "select count(distinct user_id) n_distinct from events")
def st_distinct_users(spark, sf):
    return run_to_table(W.distinct_exact(_events(spark, sf), "user_id"), "complete")


def _tags_sql(length: int) -> str:
    return f"""select {length} span, w_start, tag, n from (select *, row_number() over
  (partition by w_start order by n desc, tag) rank from (
  select b - to_days(cast(k as integer)) w_start, tag, count(*) n from (
    select time_bucket(interval '1 day', ts, timestamp '1970-01-01') b, json_extract(props, '$.k')::bigint tag
    from events) e, range({length}) t(k) where tag is not null group by 1, 2) a) r where rank <= 10"""


@register("st_top_tags", _tags_sql(6) + " union all " + _tags_sql(1))
def st_top_tags(spark, sf):
    """ST13: top 10 tags in 6-day and 1-day windows sliding by a day (the
    reference's 60 s / 10 s windows, scaled to the table's time span)."""
    out = None
    for span in (6, 1):
        c = run_to_table(W.tag_counts(_events(spark, sf), f"{span} days", "1 day"), "update", keys=["w_start", "tag"])
        c = c.withColumn("span", F.lit(span))
        top = top_n_per_group(c, ["w_start"], [F.col("n").desc(), F.col("tag")], 10).drop("rank")
        out = top if out is None else out.unionByName(top)
    return out.select("span", "w_start", "tag", "n")


ONLINE_STEPS = 3
ONLINE_STEP_SIZE = 0.1
ONLINE_YEARS = range(1990, 2011)


@register("st_logreg", None)
def st_logreg(spark, sf):
    """ML16: streaming logistic regression as one stream.  The returned-line
    labelled points arrive by ship year, in order, each year a micro-batch; a
    batch runs 3 gradient steps (step 0.1/sqrt(t)) from the weights so far.
    Result: the final weights ``(j, w)``."""
    from ..operators.learn import weights_frame
    from ..streaming.online import streaming_sgd
    from .ml_queries import DIM
    points = (Tables(spark, sf).lineitem
              .select(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("label"),
                      F.array(F.lit(1.0), F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0, F.col("l_tax") * 10.0).alias("features"),
                      F.year("l_shipdate").alias("year")).filter("year is not null"))
    folder, schema, arrivals = arrivals_by(points, "year")
    if not arrivals:
        return weights_frame(spark, [0.0] * DIM)
    rows, _ = streaming_sgd(watch(spark, folder, schema), DIM, "logistic", ONLINE_STEPS, ONLINE_STEP_SIZE, arrivals=arrivals)
    return weights_frame(spark, [r["w"] for r in rows.orderBy("j").collect()])


def _online_sql() -> str:
    import math
    from .ml_queries import _mult_sql
    s = """with d as (select year(l_shipdate) yr, case when l_returnflag='R' then 1.0::double else 0.0::double end y,
  1.0::double x0, l_quantity/50.0::double x1, l_discount*10.0::double x2, l_tax*10.0::double x3 from lineitem),
  w0 as materialized (select 0.0::double w0, 0.0::double w1, 0.0::double w2, 0.0::double w3)"""
    k = 0
    for yr in ONLINE_YEARS:
        for t in range(1, ONLINE_STEPS + 1):
            k += 1
            st = repr(ONLINE_STEP_SIZE / math.sqrt(t))
            m = _mult_sql("logistic", f"w{k-1}")
            s += (f",\n  g{k} as materialized (select " +
                  ", ".join(f"coalesce(sum({m} * x{j}) / nullif(count(*), 0), 0.0) g{j}" for j in range(4)) +
                  f" from (select * from d where yr = {yr}) t, w{k-1})")
            s += (f",\n  w{k} as materialized (select " +
                  ", ".join(f"w{k-1}.w{j} - {st}::double * g{k}.g{j} w{j}" for j in range(4)) +
                  f" from w{k-1}, g{k})")
    s += "\n" + " union all ".join(f"select {j}::int j, round(w{k}.w{j}, 9) w from w{k}" for j in range(4))
    return s


SQL["st_logreg"] = _online_sql()
