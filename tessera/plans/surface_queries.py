"""Registered queries for the text formats, sinks, caching, per-batch streams
and model checks that work on data derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import models as M
from ..operators import prep as P
from ..operators.iterate import cut_to_table
from ..operators.recommend import recommend
from ..operators.relational import bucket_split, stage
from ..session import scratch_path
from ..sources import sinks
from ..sources import text as txt
from ..sources.tables import Tables, spread
from ..streaming import pageviews as PV
from ..streaming import sketches as SK
from ..streaming import words as W
from ..streaming.runner import dir_stream, head_per_batch, run_to_table, table_stream
from . import misc_queries, ml_queries, relational
from .graphs import user_next, user_next_sql
from .ml_queries import K, _points, _ratings
from .stream_queries import _WORDS_SQL

Q = {}
SQL = {}


def register(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ------------------------------------------------------------------ text formats

@register("weighted_edge_parse", "select l_orderkey src, l_partkey dst, l_quantity weight from lineitem")
def weighted_edge_parse(spark, sf):
    """SRC5."""
    li = spread(Tables(spark, sf).lineitem)
    return txt.parse_weighted_edges(li.select(F.concat_ws("::", "l_orderkey", "l_partkey", "l_quantity").alias("value")))


@register("dense_vector_parse", "select l_quantity f0, l_discount f1, l_tax f2 from lineitem")
def dense_vector_parse(spark, sf):
    """SRC7, with a line that has too few numbers (dropped)."""
    li = spread(Tables(spark, sf).lineitem)
    lines = li.select(F.concat_ws(" ", "l_quantity", "l_discount", "l_tax").alias("value"))
    short = spark.range(1).select(F.lit("1.5").alias("value"))
    p = txt.parse_dense_vectors(lines.unionByName(short))
    return p.select(*[F.col("features")[i].alias(f"f{i}") for i in range(3)])


@register("ratings_csv_parse", """select l_orderkey::int "user", l_partkey::int item, l_quantity rating from lineitem""")
def ratings_csv_parse(spark, sf):
    """SRC8."""
    li = spread(Tables(spark, sf).lineitem)
    return txt.parse_ratings_csv(li.select(F.concat_ws(",", "l_orderkey", "l_partkey", "l_quantity").alias("value")))


@register("movielens_parse", """select l_orderkey::int "user", l_partkey::int item, l_quantity rating, l_suppkey % 10 bucket from lineitem""")
def movielens_parse(spark, sf):
    """SRC9."""
    li = spread(Tables(spark, sf).lineitem)
    return txt.parse_movielens(li.select(F.concat_ws("::", "l_orderkey", "l_partkey", "l_quantity", "l_suppkey").alias("value")))


@register("personal_ratings", """select l_partkey::int item, count(*) n from lineitem where l_quantity - 25 > 0 group by 1""")
def personal_ratings(spark, sf):
    """SRC10: ratings above zero, counted per item."""
    li = spread(Tables(spark, sf).lineitem)
    r = txt.parse_ratings_csv(li.select(F.concat_ws(",", "l_orderkey", "l_partkey", F.col("l_quantity") - 25).alias("value")))
    return txt.positive_ratings(r).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@register("category_doc_parse", """select source category, count(*) n, sum(len(string_split(text, ' ')))::bigint n_words
from documents where source is not null group by source""")
def category_doc_parse(spark, sf):
    """SRC11 / FLT5: ``category::::text`` lines; lines without the separator
    are dropped."""
    d = spread(Tables(spark, sf).documents).filter("source is not null")
    lines = d.select(F.concat("source", F.lit("::::"), "text").alias("value"))
    bad = d.select(F.col("source").alias("value"))
    return (txt.parse_category_docs(lines.unionByName(bad)).groupBy("category")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("words")).alias("n_words")))


@register("id_name_parse", "select c_custkey id, c_name name from customer")
def id_name_parse(spark, sf):
    """SRC12."""
    c = Tables(spark, sf).customer
    return txt.parse_id_names(c.select(F.concat_ws(",", "c_custkey", "c_name").alias("value")))


@register("page_view_parse", """select event_type url, case when event_type = 'error' then 500 else 200 end status,
  (user_id % 20)::int zip, user_id::int "user" from events""")
def page_view_parse(spark, sf):
    """SRC17's line format."""
    e = spread(Tables(spark, sf).events)
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    return txt.parse_page_views(e.select(F.concat_ws("\t", "event_type", status, F.col("user_id") % 20, "user_id").alias("value")))


# ------------------------------------------------------------------ files, views, caching

@register("pairs_text_round_trip", "select c_custkey || ' ' || c_name as value from customer")
def pairs_text_round_trip(spark, sf):
    """SNK1 / SRC1: pairs as a text folder, read back as lines."""
    path = scratch_path(spark, "pairs")
    sinks.write_pairs_text(Tables(spark, sf).customer, path, ["c_custkey", "c_name"])
    return txt.read_lines(spark, path)


@register("review_ratings_file", misc_queries.SQL["review_ratings"])
def review_ratings_file(spark, sf):
    """SRC15: blank-line separated review blocks written as files and read
    with a block separator."""
    path = scratch_path(spark, "reviews")
    misc_queries._review_blocks(Tables(spark, sf)).write.option("lineSep", "\n\n").text(path)
    return P.convert_reviews(txt.read_lines(spark, path, line_sep="\n\n"))


@register("catalog_view", "select o_orderstatus, count(*) n from orders group by o_orderstatus")
def catalog_view(spark, sf):
    """SRC3 / SNK3: a table as a view, queried by SQL."""
    sinks.register_view(Tables(spark, sf).orders, "surface_orders")
    return spark.sql("select o_orderstatus, count(*) n from surface_orders group by o_orderstatus")


@register("staged_counts", "select l_returnflag, count(*) n from lineitem group by l_returnflag")
def staged_counts(spark, sf):
    """CCH1-CCH3: persisted at a named level, repartitioned, forced, counted
    through its view."""
    df = stage(Tables(spark, sf).lineitem.select("l_returnflag"), "staged_lines", "MEMORY_AND_DISK_SER", partitions=8)
    out = cut_to_table(spark.sql("select l_returnflag, count(*) n from staged_lines group by l_returnflag"))
    df.unpersist()
    return out


@register("edges_spread", user_next_sql() + " select count(*) edges, count(distinct src) sources from user_next")
def edges_spread(spark, sf):
    """Edges placed by both endpoints."""
    e = G.partition_edges(user_next(Tables(spark, sf)))
    return e.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"))


# ------------------------------------------------------------------ streams

@register("st_metric_by_name", "select event_type, count(*) n from events group by event_type")
def st_metric_by_name(spark, sf):
    """ST6: a metric builder chosen by its name."""
    return run_to_table(PV.metric("pageCounts")(table_stream(spark, sf, "events")), "update", keys=["event_type"])


@register("st_batch_parity", "select 0::bigint only_batch, 0::bigint only_stream, count(distinct event_type) groups from events")
def st_batch_parity(spark, sf):
    """ST15: the same builder on the table and on its stream."""
    batch = PV.page_counts(Tables(spark, sf).events)
    stream = run_to_table(PV.page_counts(table_stream(spark, sf, "events")), "complete")
    return batch.agg(F.count(F.lit(1)).alias("groups")).select(
        batch.exceptAll(stream).agg(F.count(F.lit(1))).scalar().alias("only_batch"),
        stream.exceptAll(batch).agg(F.count(F.lit(1))).scalar().alias("only_stream"), "groups")


@register("st_head", "select event_id, user_id from events order by event_id limit 10")
def st_head(spark, sf):
    """SNK4 / SRT5: the first rows of every micro-batch, then of all."""
    e = table_stream(spark, sf, "events").select("event_id", "user_id")
    return head_per_batch(e, 10, ["event_id"]).orderBy("event_id").limit(10).drop("batch")


@register("st_page_counts_by_batch", "select event_type, count(*) n from events group by event_type")
def st_page_counts_by_batch(spark, sf):
    """ST1 per batch / SNK5: each micro-batch counted by a callback; the
    batches' counts add up."""
    per = run_to_table(table_stream(spark, sf, "events", 1), per_batch=lambda b, _: PV.page_counts(b))
    return per.groupBy("event_type").agg(F.sum("n").alias("n"))


@register("st_word_count_by_batch", _WORDS_SQL)
def st_word_count_by_batch(spark, sf):
    """ST7 per batch."""
    per = run_to_table(table_stream(spark, sf, "documents", 1), per_batch=lambda b, _: W.word_counts(b))
    return per.groupBy("word").agg(F.sum("n").alias("n"))


@register("st_watched_folder", "select event_type, count(*) n from events group by event_type")
def st_watched_folder(spark, sf):
    """SRC18: a folder that files arrive in, one file a micro-batch."""
    path = scratch_path(spark, "watched")
    Tables(spark, sf).events.repartition(3).write.parquet(path)
    e = dir_stream(spark, path, spark.read.parquet(path).schema, max_files_per_trigger=1)
    return run_to_table(PV.page_counts(e), "update", keys=["event_type"])


@register("st_distinct_sketch", "select count(distinct user_id) n_distinct, true within_bound from events")
def st_distinct_sketch(spark, sf):
    """ST12: HyperLogLog over the stream beside the exact count; the estimate
    must lie within four standard errors (1.04 / sqrt(2^12) each)."""
    est = run_to_table(W.distinct_hll(table_stream(spark, sf, "events"), "user_id"), "complete")
    exact = Tables(spark, sf).events.agg(F.count_distinct("user_id").alias("n_distinct"))
    return exact.select("n_distinct", (F.abs(est.scalar() - F.col("n_distinct")) <= F.greatest(F.lit(2.0), 0.065 * F.col("n_distinct"))).alias("within_bound"))


PARTS, PHI, WIDTH = 4, 0.005, 544  # groups of batches; share of a heavy hitter; cells of a sketch row


def _event_parts(spark, sf):
    """The events as a folder that files arrive in, a few for each of 4 parts,
    read one file a micro-batch."""
    path = scratch_path(spark, "parts")
    e = Tables(spark, sf).events.select("user_id", F.pmod("event_id", F.lit(PARTS)).cast("int").alias("part"))
    e.repartition(2, "user_id").withColumn("p", F.col("part")).write.partitionBy("p").parquet(path)
    return dir_stream(spark, f"{path}/p=*", e.schema, max_files_per_trigger=1)


def _cell_sql(a, b):
    return f"(((user_id % {SK.PRIME}) * {a} + {b}) % {SK.PRIME} % {WIDTH})"


_HEAVY_SQL = f"""with e as (select user_id, cast(event_id % {PARTS} as integer) part from events),
  s as (select part, user_id from e union all select -1, user_id from e),
  n as (select part, count(*) total from s group by part),
  x as (select part, user_id, count(*) n from s group by all),
  c as ({" union all ".join(f"select part, {r} as r, {_cell_sql(a, b)} as cell, sum(n) as m from x group by all" for r, (a, b) in enumerate(SK.HASHES))}),
  at as ({" union all ".join(f"select part, user_id, n, {r} as r, {_cell_sql(a, b)} as cell from x" for r, (a, b) in enumerate(SK.HASHES))}),
  est as (select part, user_id, n, min(m) estimate from at join c using (part, r, cell) group by all)
select part, user_id, cast(n as bigint) n, cast(estimate as bigint) estimate,
  estimate between n and n + ceil({2.718281828459045 / WIDTH!r}::double * total) within_bound
from est join n using (part) where estimate >= {PHI} * total"""


@register("st_heavy_sketch", _HEAVY_SQL.replace("at as (", "pos as (").replace("from at join", "from pos join"))
def st_heavy_sketch(spark, sf):
    """ST11: heavy hitters from count-min sketches that micro-batches leave
    behind, merged for each part and for all (part -1), beside the exact
    counts of the keys reported."""
    per = run_to_table(_event_parts(spark, sf), per_batch=lambda b, _: SK.heavy_batch(b, "user_id", PHI, WIDTH, ("part",)))
    both = per.unionByName(per.withColumn("part", F.lit(-1)))
    hits = SK.heavy_hitters(both, PHI, WIDTH, ("part",)).withColumnRenamed("key", "user_id")
    e = Tables(spark, sf).events.groupBy("user_id", F.pmod("event_id", F.lit(PARTS)).cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    exact = e.unionByName(e.groupBy("user_id").agg(F.sum("n").alias("n")).withColumn("part", F.lit(-1)))
    return hits.join(exact, ["part", "user_id"]).select(
        "part", "user_id", "n", "estimate",
        F.col("estimate").between(F.col("n"), F.col("n") + SK.error_bound(F.col("total"), WIDTH)).alias("within_bound"))


@register("st_distinct_union", f"""with e as (select user_id, cast(event_id % {PARTS} as integer) part from events),
  s as (select * from e union all select user_id, -1 from e),
  d as (select part, count(distinct user_id) n_distinct from s group by part)
select part, n_distinct, cast(floor(n_distinct * 0.935) as bigint) least, cast(ceil(n_distinct * 1.065) as bigint) most,
  n_distinct between floor(n_distinct * 0.935) and ceil(n_distinct * 1.065) within_bound from d""")
def st_distinct_union(spark, sf):
    """ST12: HyperLogLog sketches stored for each micro-batch, united for each
    part and for all (part -1), beside the exact counts.  An estimate must lie
    within four standard errors (1.04 / sqrt(2^12) each) of its count."""
    per = run_to_table(_event_parts(spark, sf), per_batch=lambda b, _: SK.distinct_batch(b, "user_id", ("part",)))
    est = SK.distinct_union(per.unionByName(per.withColumn("part", F.lit(-1))), ("part",))
    e = Tables(spark, sf).events.select("user_id", F.pmod("event_id", F.lit(PARTS)).cast("int").alias("part")).distinct()
    exact = e.unionByName(e.withColumn("part", F.lit(-1))).groupBy("part").agg(F.count_distinct("user_id").alias("n_distinct"))
    low, high = F.floor(F.col("n_distinct") * 0.935), F.ceil(F.col("n_distinct") * 1.065)
    return exact.join(est, "part").select("part", "n_distinct", low.alias("least"), high.alias("most"), F.col("estimate").between(low, high).alias("within_bound"))


@register("error_marks", """select zip, case when r > 0.05 then '**' || printf('%.4f', r) || '**' else printf('%.4f', r) end mark
from (select user_id % 20 zip, count(*) filter (where event_type = 'error') / count(*) r from events group by 1)""")
def error_marks(spark, sf):
    """FN12: error ratio per zip as text, marked above the threshold."""
    e = Tables(spark, sf).events
    r = e.groupBy(F.pmod("user_id", F.lit(PV.ZIPS)).alias("zip")).agg(F.avg((F.col("event_type") == "error").cast("int")).alias("ratio"))
    return r.select("zip", PV.marked().alias("mark"))


# ------------------------------------------------------------------ recommendations

RANK, BEST = 8, 10


def _start_factor(j: int) -> str:
    return f"(((item * {2 * j + 3} + {j * j + 1}) % 97) / 97.0D - 0.4931D)"


def _recommend_sql() -> str:
    dims = range(RANK)
    start = ", ".join(_start_factor(j).replace("D", "::double") + f" v{j}" for j in dims)
    half = lambda key, f, out: ", ".join(f"sum(rating * {f}{j}) / count(*) {out}{j}" for j in dims)
    dot = " + ".join(f"u{j} * v{j}" for j in dims)
    return relational._RATINGS_SQL + f""", r as (select *, {start} from ratings),
  u as (select "user", {half("user", "v", "u")} from r group by "user"),
  v as (select item, {half("item", "u", "v")} from ratings join u using ("user") group by item),
  s as (select "user", item, round({dot}, 9) score from u cross join v
        where not exists (select 1 from ratings x where x."user" = u."user" and x.item = v.item)),
  t as (select *, row_number() over (partition by "user" order by score desc, item) rank from s)
select "user", item, score, rank from t where rank <= {BEST}"""


@register("als_recommend", _recommend_sql())
def als_recommend(spark, sf):
    """SRT6: the 10 best parts for every customer among those not bought,
    from factor tables: item factors start as fixed numbers, then users and
    items take one step of alternation each (their ratings' mean product)."""
    r = cut_to_table(relational.ratings(Tables(spark, sf)).select("user", "item", "rating"))
    side = lambda d, key, f: d.groupBy(key).agg(*((F.sum(F.col("rating") * f(j)) / F.count(F.lit(1))).alias(f"f{j}") for j in range(RANK)))
    users = side(r, "user", lambda j: F.expr(_start_factor(j)))
    items = side(r.join(cut_to_table(users), "user"), "item", lambda j: F.col(f"f{j}"))
    factors = F.array(*(F.col(f"f{j}") for j in range(RANK))).alias("factors")
    return recommend(cut_to_table(users.select("user", factors)), cut_to_table(items.select("item", factors)), BEST, r)


# ------------------------------------------------------------------ model checks

@register("pca_variance", """with p as (select vec_id, unnest(range(64)) j, unnest(embedding)::double x from embeddings)
select (select count(*) from embeddings) n, cast(printf('%.5e', sum(v)) as double) variance from (select var_samp(x) v from p group by j)""")
def pca_variance(spark, sf):
    """ML11: with as many components as dimensions PCA keeps all variance."""
    _, proj = M.pca_project(_points(Tables(spark, sf)), 64)
    var = [F.var_samp(F.col("projected")[i]) for i in range(64)]
    total = var[0]
    for v in var[1:]:
        total = total + v
    return proj.agg(F.count(F.lit(1)).alias("n"), F.format_string("%.5e", total).cast("double").alias("variance"))


@register("kmeans_parallel_check", f"""select count(*) n, {K}::bigint clusters, true cost_agrees from embeddings""")
def kmeans_parallel_check(spark, sf):
    """ML10: every point assigned, every cluster used, and the reported cost
    equal to the one recomputed from the assignments."""
    pts = _points(Tables(spark, sf))
    _, assigned, cost = M.kmeans_parallel(pts, k=K, seed=127)
    long = cut_to_table(assigned).select("vec_id", "cluster", F.posexplode("features").alias("j", "x"))
    # the cost of a cluster is its size times its variance, per dimension
    again = long.groupBy("cluster", "j").agg((F.var_pop("x") * F.count(F.lit(1))).alias("c")).agg(F.sum("c"))
    return assigned.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("clusters")).select(
        "n", "clusters", (again.scalar() <= cost.scalar() * 1.000001).alias("cost_agrees"))


@register("als_check", relational._RATINGS_SQL + "select count(*) scored, true beats_mean from ratings where split = 'test'")
def als_check(spark, sf):
    """ML7 / JN6: every test rating meets its prediction on (user, item);
    training error lies below that of the mean."""
    r = bucket_split(_ratings(Tables(spark, sf)), F.col("bucket"), relational.SPLITS)
    train, test = r.filter("split <> 'test'"), r.filter("split = 'test'")
    mu, sd = train.agg(F.avg("rating"), F.stddev_pop("rating")).first()
    m = M.als(train, rank=10, iters=3, reg=0.01)
    fit = M.rmse(m, train, mu)
    return M.score(m, test, mu).agg(F.count("prediction").alias("scored"), F.lit(fit < sd).alias("beats_mean"))


@register("tree_check", "select (select count(*) from embeddings) n_cls, true cls_beats_majority, (select count(*) from lineitem) n_reg, true reg_beats_mean")
def tree_check(spark, sf):
    """ML4 / ML5: training errors below those of the majority class and of the
    mean, over all rows."""
    t = Tables(spark, sf)
    pts = t.embeddings.select(F.col("label").cast("double").alias("label"),
                              F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    err = ml_queries.tree_cls(spark, sf).first()["training_error"]
    n, top = pts.groupBy("label").count().agg(F.sum("count"), F.max("count")).first()
    reg = ml_queries.tree_reg(spark, sf).first()["rmse"]
    m, sd = t.lineitem.agg(F.count(F.lit(1)), F.stddev_pop("l_extendedprice")).first()
    return spark.createDataFrame([(n, bool(err < 1 - top / n), m, bool(reg < sd))],
                                 "n_cls long, cls_beats_majority boolean, n_reg long, reg_beats_mean boolean")
