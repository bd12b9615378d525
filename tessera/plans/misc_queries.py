"""Registered sort-benchmark, data-preparation and reporting queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import ntz_micros
from ..operators import prep as P
from ..operators import report as R
from ..operators import sortbench as S
from ..operators.learn import WHITESPACE
from ..operators.relational import global_row_number
from ..session import scratch_path
from ..sources.tables import Tables, spread

Q = {}
SQL = {}

RANGE_PARTS = 10
PAGE_MIN_CHARS = 100


def register(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _jhash_sql(expr: str) -> str:
    return (f"cast(list_reduce(list_transform(string_split({expr}, ''), lambda c: cast(unicode(c) as bigint)),"
            f" lambda h, c: ((h*31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648,"
            f" cast(0 as bigint)) as integer)")


# ------------------------------------------------------------------ sorting

@register("token_sort", r"""select token, doc_id, row_number() over (order by token, doc_id) rank from
  (select doc_id, unnest(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+')) token from documents) t
where length(token) > 0""")
def token_sort(spark, sf):
    """TS5 / SRT1: every whitespace token of every document in one global
    order (token, then document), with its rank."""
    d = spread(Tables(spark, sf).documents)
    tok = (d.select("doc_id", F.explode(F.split("text", WHITESPACE)).alias("token"))
           .filter(F.length("token") > 0))
    return global_row_number(tok, ["token", "doc_id"]).select("token", "doc_id", "rank")


def lineitem_records(t: Tables):
    """100-byte sort records derived from lineitem: key = first 10 bytes of
    SHA-256 of the row's ids, value = first 90 bytes of the SHA-256 digests
    of the ids suffixed with |1, |2 and |3."""
    ids = F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    dig = lambda sfx: F.unhex(F.sha2(F.concat(ids, F.lit(sfx)), 256))
    return spread(t.lineitem).select(
        F.substring(F.unhex(F.sha2(ids, 256)), 1, S.KEY_LEN).alias("key"),
        F.substring(F.concat(dig("|1"), dig("|2"), dig("|3")), 1, S.VALUE_LEN).alias("value"))


def _crc32_sql(byte_list: str) -> str:
    """CRC-32 (IEEE, reflected polynomial 0xEDB88320) of a list of byte
    values, bit by bit, for the DuckDB oracle (which has no crc32)."""
    return (f"xor(list_reduce({byte_list}, lambda c, b: list_reduce(range(8), lambda c2, k: "
            f"case when (c2 & 1) = 1 then xor(c2 >> 1, 3988292384) else c2 >> 1 end, xor(c, b)), "
            f"4294967295), 4294967295)")


def _hex_bytes_sql(hex_expr: str, n: int) -> str:
    return f"list_transform(range({n}), lambda i: ('0x' || substr({hex_expr}, 2*i + 1, 2))::bigint)"


_TERASORT_SQL = f"""with r as (select concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber) ids from lineitem),
  h as (select substr(sha256(ids), 1, 20) k,
          substr(sha256(ids), 1, 20) || substr(sha256(ids || '|1') || sha256(ids || '|2') || sha256(ids || '|3'), 1, 180) kv
        from r)
select count(*) records, cast(sum({_crc32_sql(_hex_bytes_sql('k', 10))}) as decimal(38,0)) checksum,
  cast(sum({_crc32_sql(_hex_bytes_sql('kv', 100))}) as decimal(38,0)) full_checksum,
  0::bigint violations,
  count(*) records_in, cast(sum({_crc32_sql(_hex_bytes_sql('k', 10))}) as decimal(38,0)) checksum_in from h"""


@register("binary_range_bucket", f"""select least(floor(('0x' || substr(sha256(concat_ws('|', l_orderkey, l_partkey,
  l_suppkey, l_linenumber)), 1, 14))::bigint / {((1 << 56) - 1) // RANGE_PARTS}), {RANGE_PARTS - 1})::int bucket,
  count(*) n from lineitem group by 1""")
def binary_range_bucket(spark, sf):
    """TS3: records per range partition under the explicit 7-byte-prefix
    partition function."""
    r = lineitem_records(Tables(spark, sf))
    return r.groupBy(S.range_bucket(F.col("key"), RANGE_PARTS).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))


@register("terasort_valid", _TERASORT_SQL)
def terasort_valid(spark, sf):
    """TS2 + TS4 + SNK2: sort the lineitem records by key, write them as
    Parquet into the shared folder, and validate the files in the order of
    their names: records and key checksum before and after must agree, 0
    ordering violations."""
    recs = lineitem_records(Tables(spark, sf))
    path = scratch_path(spark, "sorted")
    S.write_sorted(recs, path)
    after = S.validate_files(spark, path).drop("partitions")
    before = S.checksum(recs)
    return after.select("*", before.select("records").scalar().alias("records_in"),
                        before.select("checksum").scalar().alias("checksum_in"))


@register("sorted_files", """with r as (select substr(sha256(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)), 1, 20) k from lineitem)
select row_number() over (order by k) - 1 place, k from r""")
def sorted_files(spark, sf):
    """TS2: every key with its place in the sorted table, counted along the
    files on disk: rows in the files before, and rows before it in its own."""
    path = scratch_path(spark, "sorted")
    S.write_sorted(lineitem_records(Tables(spark, sf)), path)
    rows = S.read_sorted(spark, path)
    size = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))  # one row per file
    before = size.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))
    return rows.join(F.broadcast(before), "file").select((F.col("base") + F.col("row")).alias("place"), F.lower(F.hex("key")).alias("k"))


@register("fixed_records", """with r as (select sha256(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)) h from lineitem)
select substr(h, 1, 10) k, substr(h || h, 11, 89) || chr(10) v from r""")
def fixed_records(spark, sf):
    """SRC13: the fixed-width reader over files of 100-byte records (10-byte
    key; 89 characters and a line break), which the text sink writes."""
    from ..sources.records import read_records
    h = F.sha2(F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), 256)
    path = scratch_path(spark, "records")
    spread(Tables(spark, sf).lineitem).select(F.concat(F.substring(h, 1, 10), F.substring(F.concat(h, h), 11, 89)).alias("value")).write.text(path)
    return read_records(spark, path).select(F.decode("key", "UTF-8").alias("k"), F.decode("value", "UTF-8").alias("v"))


# ------------------------------------------------------------------ preparation

def _review_blocks(t: Tables):
    """Review blocks built from sales lines: 8 ``key: value`` fields, a line
    without ':' in line-6 blocks (skipped), and line-7 blocks missing the
    summary (7 fields, dropped)."""
    li = spread(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity"))
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    secs = F.floor(ntz_micros("o_orderdate") / 1_000_000).cast("long").cast("string")
    lines = [
        F.concat(F.lit("product/productId: B"), F.col("l_partkey").cast("string")),
        F.concat(F.lit("review/userId: A"), F.col("o_custkey").cast("string")),
        F.concat(F.lit("review/profileName: customer "), F.col("o_custkey").cast("string")),
        F.concat(F.lit("review/helpfulness: "), F.col("l_linenumber").cast("string"), F.lit("/7")),
        F.concat(F.lit("review/score: "), (F.col("l_quantity") / 10.0).cast("string")),
        F.concat(F.lit("review/time: "), secs),
        F.when(F.col("l_linenumber") != 7,
               F.concat(F.lit("review/summary: order "), F.col("l_orderkey").cast("string"))),
        F.when(F.col("l_linenumber") == 6, F.lit("a line without separator")),
        F.lit("review/text: bought it"),
    ]
    return j.select(F.concat_ws("\n", *lines).alias("value"))


@register("review_ratings", f"""select {_jhash_sql("'B' || l_partkey")} || '::' || {_jhash_sql("'A' || o_custkey")}
  || '::' || cast(l_quantity / 10.0::double as varchar) || '::' || cast(epoch(o_orderdate)::bigint as varchar) line
from lineitem join orders on l_orderkey = o_orderkey where l_linenumber <> 7""")
def review_ratings(spark, sf):
    return P.convert_reviews(_review_blocks(Tables(spark, sf)))


_PAGE_SQL = r"""with p as (select page_id,
  translate(regexp_extract(html, '<title>([^<]*)</title>', 1), chr(13) || chr(10), '  ') title,
  trim(regexp_replace(translate(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g'),
       chr(13) || chr(10), '  '), ' +', ' ', 'g')) text,
  array_to_string(list_transform(regexp_extract_all(html, '<li><a href="/([^"]*)">', 1), lambda c: ':' || c), '') category
  from pages)
"""


@register("page_corpus", _PAGE_SQL + f"""select page_id, category || ' :::: ' || title || ' ' || text line
from p where length(text) >= {PAGE_MIN_CHARS}""")
def page_corpus(spark, sf):
    return P.page_corpus(spread(Tables(spark, sf).pages), PAGE_MIN_CHARS)


@register("page_counts", _PAGE_SQL + f"""select count(*) pages, count(*) filter (where length(text) >= {PAGE_MIN_CHARS}) big_pages,
  count(*) filter (where length(text) >= {PAGE_MIN_CHARS} and length(category) > 0) with_category from p""")
def page_counts(spark, sf):
    return P.page_counters(spread(Tables(spark, sf).pages), PAGE_MIN_CHARS)


# ------------------------------------------------------------------ reporting

STAGES = 7


def event_log_lines(t: Tables):
    """A listener event log (JSON lines) derived from ``events``: a task per
    event (type, stage, timing and metrics from the event's fields; error
    events carry no metrics), a completed-stage record per stage, and the
    application start and end."""
    e = spread(t.events)
    ms = F.floor(ntz_micros("ts") / 1000).cast("long")
    fin = ms + F.floor(F.col("value") * 100).cast("long")
    method = (F.when(F.col("event_type") == "purchase", "Hadoop")
              .when(F.col("event_type") == "view", "Memory")
              .when(F.col("event_type") == "click", "Disk")
              .when(F.col("event_type") == "signup", "Network"))
    metrics = F.when(F.col("event_type") != "error", F.struct(
        F.struct(method.alias("Data Read Method"),
                 F.floor(F.col("value") * 1000).cast("long").alias("Bytes Read")).alias("Input Metrics"),
        F.struct(F.pmod("event_id", F.lit(1000)).alias("Remote Bytes Read")).alias("Shuffle Read Metrics"),
        F.struct((F.col("user_id") * 10).alias("Shuffle Bytes Written")).alias("Shuffle Write Metrics")))
    task = e.select(F.to_json(F.struct(
        F.lit("SparkListenerTaskEnd").alias("Event"),
        F.when(F.col("event_type").isin("view", "click", "signup"), "ShuffleMapTask")
        .otherwise("ResultTask").alias("Task Type"),
        F.struct(F.pmod("user_id", F.lit(STAGES)).alias("Stage ID"), ms.alias("Launch Time"),
                 fin.alias("Finish Time")).alias("Task Info"),
        metrics.alias("Task Metrics"))).alias("value"))
    st = (e.groupBy(F.pmod("user_id", F.lit(STAGES)).alias("sid"))
          .agg(F.min(ms).alias("s"), F.max(fin).alias("f"))
          .select(F.to_json(F.struct(F.lit("SparkListenerStageCompleted").alias("Event"),
                                     F.struct(F.col("sid").alias("Stage ID"), F.col("s").alias("Submission Time"),
                                              F.col("f").alias("Completion Time")).alias("Stage Info")))
                  .alias("value")))
    app = e.agg(F.min(ms).alias("a"), F.max(fin).alias("b")).select(F.explode(F.array(
        F.to_json(F.struct(F.lit("SparkListenerApplicationStart").alias("Event"), F.col("a").alias("Timestamp"))),
        F.to_json(F.struct(F.lit("SparkListenerApplicationEnd").alias("Event"), F.col("b").alias("Timestamp")))))
        .alias("value"))
    return task.unionByName(st).unionByName(app)


@register("event_log_summary", f"""with e as (select *, epoch_us(ts) // 1000 ms, epoch_us(ts) // 1000 + cast(floor(value * 100) as bigint) fin,
  case when event_type in ('view','click','signup') then 'ShuffleMapTask' else 'ResultTask' end tt,
  case event_type when 'purchase' then 'Hadoop' when 'view' then 'Memory' when 'click' then 'Disk'
       when 'signup' then 'Network' end method from events)
select count(*) tasks, count(*) filter (where fin - ms > 0) tasks_nonempty,
  count(*) filter (where tt = 'ShuffleMapTask') shuffle_tasks, count(*) filter (where tt = 'ResultTask') result_tasks,
  coalesce(sum(fin - ms) filter (where tt = 'ShuffleMapTask'), 0)::bigint shuffle_task_ms,
  coalesce(sum(fin - ms) filter (where tt = 'ResultTask'), 0)::bigint result_task_ms,
  coalesce(sum(cast(floor(value * 1000) as bigint)) filter (where method is not null), 0)::bigint input_bytes,
  coalesce(sum(cast(floor(value * 1000) as bigint)) filter (where method = 'Hadoop'), 0)::bigint input_hadoop,
  coalesce(sum(cast(floor(value * 1000) as bigint)) filter (where method = 'Memory'), 0)::bigint input_memory,
  coalesce(sum(cast(floor(value * 1000) as bigint)) filter (where method = 'Disk'), 0)::bigint input_disk,
  coalesce(sum(cast(floor(value * 1000) as bigint)) filter (where method = 'Network'), 0)::bigint input_network,
  coalesce(sum(event_id % 1000) filter (where event_type <> 'error'), 0)::bigint shuffle_read,
  coalesce(sum(user_id * 10) filter (where event_type <> 'error'), 0)::bigint shuffle_write,
  (select count(distinct user_id % {STAGES}) from events) stages,
  (select sum(f - s) from (select min(ms) s, max(fin) f from e group by user_id % {STAGES}) x)::bigint stage_ms,
  floor((max(fin) - min(ms)) / 60000)::bigint app_minutes
from e""")
def event_log_summary(spark, sf):
    ev = R.parse_event_log(event_log_lines(Tables(spark, sf)))
    return R.event_log_summary(ev)


@register("run_report", """select event_type type, min(ts) start,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 duration_s, sum(value) * 1000 / (1024.0 * 1024.0) size_mb,
  case when epoch_us(max(ts)) > epoch_us(min(ts)) then (sum(value) * 1000 / (1024.0 * 1024.0))
       / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) end throughput_mb_s,
  case when count(*) filter (where value < 1.0) > 0 then 'FAILED' else 'OK' end status
from events group by event_type""")
def run_report(spark, sf):
    """RPT1: one 'run' per event type (start, end, bytes = 1000 x value,
    failed when it holds a value below 1)."""
    e = Tables(spark, sf).events
    runs = e.groupBy(F.col("event_type").alias("type")).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"),
        (F.sum("value") * 1000).alias("bytes"), (F.count_if(F.col("value") < 1.0) > 0).alias("failed"))
    return R.run_report(runs)
