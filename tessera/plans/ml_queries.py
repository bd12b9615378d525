"""Registered machine-learning queries and their oracles (unrolled CTE
chains for fixed-step training loops)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import java_hash_code, sig
from ..operators import learn as L
from ..sources.tables import Tables

Q = {}
SQL = {}

SGD_STEPS = 3
SVM_REG = 0.01
K = 10
KM_STEPS = 5
DIM = 4


def register(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ------------------------------------------------------------------ data

def sgd_data(t: Tables):
    """label = returned line; x = (1, quantity/50, discount*10, tax*10);
    ``b`` = deterministic 90/10 bucket for the SVM train/test split."""
    li = t.lineitem
    return li.select(
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("label"),
        F.array(F.lit(1.0), F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0,
                F.col("l_tax") * 10.0).alias("features"),
        F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(10)).alias("b"))


_DATA_SQL = """d as (select case when l_returnflag='R' then 1.0::double else 0.0::double end y,
  1.0::double x0, l_quantity/50.0::double x1, l_discount*10.0::double x2, l_tax*10.0::double x3,
  (l_orderkey + l_linenumber) % 10 b from lineitem)"""


def _margin_sql(w: str) -> str:
    return f"({w}.w0*x0 + {w}.w1*x1 + {w}.w2*x2 + {w}.w3*x3)"


def _mult_sql(kind: str, w: str) -> str:
    mg = _margin_sql(w)
    if kind == "logistic":
        return f"(1.0::double/(1.0::double + exp(-{mg})) - y)"
    if kind == "hinge":
        return f"(case when (2.0*y-1.0)*{mg} < 1.0 then -(2.0*y-1.0) else 0.0::double end)"
    return f"({mg} - y)"


def sgd_sql(kind: str, steps: int, reg: float, where: str = "true") -> str:
    s = "with " + _DATA_SQL + f",\n  t as (select * from d where {where}),\n"
    s += "  w0 as materialized (select 0.0::double w0, 0.0::double w1, 0.0::double w2, 0.0::double w3)"
    import math
    for i in range(1, steps + 1):
        st = repr(1.0 / math.sqrt(i))
        m = _mult_sql(kind, f"w{i-1}")
        s += (f",\n  g{i} as materialized (select " +
              ", ".join(f"sum({m} * x{j}) / count(*) g{j}" for j in range(DIM)) +
              f" from t, w{i-1})")
        s += (f",\n  w{i} as materialized (select " +
              ", ".join(f"w{i-1}.w{j} * (1.0::double - {st}::double * {reg!r}::double) - {st}::double * g{i}.g{j} w{j}"
                        for j in range(DIM)) + f" from w{i-1}, g{i})")
    return s


def _weights_rows_sql(w: str) -> str:
    return " union all ".join(f"select {j}::int j, round({w}.w{j}, 9) w from {w}" for j in range(DIM))


# ------------------------------------------------------------------ SGD models

def _train(t, kind, reg=0.0, where=None):
    d = sgd_data(t)
    if where is not None:
        d = d.filter(where)
    return L.sgd(d, kind, SGD_STEPS, DIM, step=1.0, reg=reg)


@register("logreg_sgd_3", sgd_sql("logistic", SGD_STEPS, 0.0) + "\n" + _weights_rows_sql(f"w{SGD_STEPS}"))
def logreg_sgd_3(spark, sf):
    return L.weights_frame(spark, _train(Tables(spark, sf), "logistic"))


@register("svm_sgd_3", sgd_sql("hinge", SGD_STEPS, SVM_REG, "b < 9") + "\n" + _weights_rows_sql(f"w{SGD_STEPS}"))
def svm_sgd_3(spark, sf):
    return L.weights_frame(spark, _train(Tables(spark, sf), "hinge", SVM_REG, F.col("b") < 9))


@register("linreg_sgd_3", sgd_sql("least_squares", SGD_STEPS, 0.0) + "\n" + _weights_rows_sql(f"w{SGD_STEPS}"))
def linreg_sgd_3(spark, sf):
    return L.weights_frame(spark, _train(Tables(spark, sf), "least_squares"))


@register("linreg_mse", sgd_sql("least_squares", SGD_STEPS, 0.0) +
          f"\nselect round(avg(({_margin_sql('w' + str(SGD_STEPS))} - y) * ({_margin_sql('w' + str(SGD_STEPS))} - y)), 9) mse"
          f" from t, w{SGD_STEPS}")
def linreg_mse(spark, sf):
    t = Tables(spark, sf)
    w = _train(t, "least_squares")
    d = sgd_data(t)
    return L.mse(d, L.margin(w)).select(F.round("mse", 9).alias("mse"))


@register("error_rate", sgd_sql("logistic", SGD_STEPS, 0.0) +
          f"\nselect round(avg(case when (case when 1.0::double/(1.0::double + exp(-{_margin_sql('w3')})) > 0.5"
          f" then 1.0 else 0.0 end) <> y then 1.0 else 0.0 end), 9) error_rate from t, w{SGD_STEPS}")
def q_error_rate(spark, sf):
    """AGG15: training error of the logistic model (threshold 0.5)."""
    t = Tables(spark, sf)
    w = _train(t, "logistic")
    pred = F.when(F.lit(1.0) / (F.lit(1.0) + F.exp(-L.margin(w))) > 0.5, 1.0).otherwise(0.0)
    return L.error_rate(sgd_data(t), pred).select(F.round("error_rate", 9).alias("error_rate"))


def _auc_sql(scores: str) -> str:
    return f""", sc as ({scores}),
  g as (select s, sum(y) pos, sum(1.0 - y) neg from sc group by s),
  c as (select s, pos, neg, coalesce(sum(neg) over (order by s rows between unbounded preceding and 1 preceding), 0.0) below from g)
select round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 9) auc from c"""


@register("auc_quantity", "with " + _DATA_SQL + _auc_sql(
    "select l_quantity::double s, case when l_returnflag='R' then 1.0 else 0.0 end::double y from lineitem"))
def auc_quantity(spark, sf):
    li = Tables(spark, sf).lineitem
    a = L.exact_auc(li, F.col("l_quantity"), (F.col("l_returnflag") == "R").cast("double"))
    return a.select(F.round("auc", 9).alias("auc"))


@register("svm_auc", sgd_sql("hinge", SGD_STEPS, SVM_REG, "b < 9") + _auc_sql(
    f"select {_margin_sql('w3')} s, y from d, w{SGD_STEPS} where b >= 9"))
def svm_auc(spark, sf):
    """ML2 + AGG16: SVM trained on the 90 % bucket, raw scores on the rest."""
    t = Tables(spark, sf)
    w = _train(t, "hinge", SVM_REG, F.col("b") < 9)
    test = sgd_data(t).filter(F.col("b") >= 9)
    return L.exact_auc(test, L.margin(w), F.col("label")).select(F.round("auc", 9).alias("auc"))


# ------------------------------------------------------------------ K-means

def _points(t):
    return t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features"))


def _init_centres(pts, k):
    rows = pts.orderBy("vec_id").limit(k).collect()  # K rows: the initial model
    return [list(r["features"]) for r in rows]


_FIRST_K_SQL = f"""
  ids as (select vec_id id, (row_number() over (order by vec_id) - 1)::int k from embeddings order by vec_id limit {K})"""


def kmeans_sql(steps: int, ids: str = _FIRST_K_SQL) -> str:
    """Lloyd steps from the points ``ids(id, k)``."""
    s = f"""with p as materialized (select vec_id id, unnest(range(64)) j, unnest(embedding)::double x from embeddings),{ids},
  c0 as materialized (select ids.k, p.j, p.x c from p join ids on ids.id = p.id)"""
    for i in range(1, steps + 2):
        s += (f",\n  a{i} as materialized (select id, arg_min(k, (d, k)) k, min(d) d from (select p.id, c.k,"
              f" round(sum((p.x - c.c) * (p.x - c.c)), 9) d from p join c{i-1} c on c.j = p.j group by p.id, c.k) z group by id)")
        if i <= steps:
            s += (f",\n  c{i} as materialized (select c.k, c.j, coalesce(n.c, c.c) c from c{i-1} c left join"
                  f" (select a.k, p.j, avg(p.x) c from a{i} a join p on p.id = a.id group by a.k, p.j) n"
                  f" on n.k = c.k and n.j = c.j)")
    return s


@register("kmeans_lloyd_5", kmeans_sql(KM_STEPS) + f"\nselect id vec_id, k cluster from a{KM_STEPS + 1}")
def kmeans_lloyd_5(spark, sf):
    pts = _points(Tables(spark, sf))
    c = L.kmeans_lloyd(pts, _init_centres(pts, K), KM_STEPS)
    return L.kmeans_assign(pts, c).select("vec_id", "cluster")


@register("kmeans_wssse", kmeans_sql(KM_STEPS) +
          f"\nselect cast(printf('%.8e', sum(d)) as double) wssse from (select p.id, min(s) d from (select p.id, c.k,"
          f" sum((p.x - c.c) * (p.x - c.c)) s from p join c{KM_STEPS} c on c.j = p.j group by p.id, c.k) p group by p.id) q")
def kmeans_wssse(spark, sf):
    pts = _points(Tables(spark, sf))
    c = L.kmeans_lloyd(pts, _init_centres(pts, K), KM_STEPS)
    return L.wssse(pts, c).select(sig("wssse", 9).alias("wssse"))


# ------------------------------------------------------------------ aggregates

@register("split_stats", """
with s as (select 'quantity' feature, floor((l_quantity - 1) / 5)::bigint bin, l_returnflag y from lineitem
           union all select 'discount', round(l_discount * 100)::bigint, l_returnflag from lineitem
           union all select 'tax', round(l_tax * 100)::bigint, l_returnflag from lineitem),
     c as (select feature, bin, y, count(*) c from s group by feature, bin, y)
select feature, bin, sum(c)::bigint n, round(1.0 - sum(c * c) / (sum(c) * sum(c)), 9) gini from c group by feature, bin""")
def q_split_stats(spark, sf):
    li = Tables(spark, sf).lineitem
    s = L.split_stats(li, {"quantity": F.floor((F.col("l_quantity") - 1) / 5),
                           "discount": F.round(F.col("l_discount") * 100),
                           "tax": F.round(F.col("l_tax") * 100)}, "l_returnflag")
    return s.select("feature", "bin", "n", F.round("gini", 9).alias("gini"))


_COV_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("covariance", " union all ".join(
    f"select {i}::int i, {j}::int j, cast(printf('%.8e', covar_pop({_COV_COLS[i]}, {_COV_COLS[j]})) as double) cov from lineitem"
    for i in range(4) for j in range(i, 4)))
def q_covariance(spark, sf):
    c = L.covariance(Tables(spark, sf).lineitem, _COV_COLS)
    return c.select("i", "j", sig("cov", 9).alias("cov"))


# ------------------------------------------------------------------ TF-IDF

_TFIDF_SQL = r"""with tok as (select doc_id doc, unnest(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+')) term from documents),
  tf as (select doc, term, count(*) tf from tok where length(term) > 0 group by doc, term),
  m as (select count(*) m from documents),
  df as (select term, count(*) df from tf group by term),
  x as (select tf.doc, tf.term, tf.tf, tf.tf * case when df >= 2 then ln((m + 1.0::double) / (df + 1.0::double)) else 0.0 end tfidf
        from tf join df on df.term = tf.term, m)
"""


@register("tfidf_terms", _TFIDF_SQL + "select doc doc_id, term, tf, round(tfidf, 9) tfidf from x")
def tfidf_terms(spark, sf):
    x = L.tfidf(Tables(spark, sf).documents, "doc_id", "text")
    return x.select(F.col("doc").alias("doc_id"), "term", "tf", F.round("tfidf", 9).alias("tfidf"))


@register("tfidf_labelled", _TFIDF_SQL + """
select d.doc_id, cast(list_reduce(list_transform(string_split(d.lang, ''), lambda c: cast(unicode(c) as bigint)),
       lambda h, c: ((h*31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, cast(0 as bigint)) as integer) label,
       count(x.term) filter (where x.tfidf > 0) n_terms,
       cast(printf('%.8e', coalesce(sqrt(sum(x.tfidf * x.tfidf)), 0.0)) as double) norm
from documents d left join x on x.doc = d.doc_id group by d.doc_id, d.lang""")
def tfidf_labelled(spark, sf):
    """ML14: TF-IDF rows labelled by the document's category (here the
    language) through its 32-bit string hash."""
    d = Tables(spark, sf).documents
    x = L.tfidf(d, "doc_id", "text")
    agg = x.groupBy("doc").agg(F.count_if(F.col("tfidf") > 0).alias("n_terms"),
                               F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))).alias("norm"))
    return (d.select("doc_id", java_hash_code("lang").alias("label"))
            .join(agg, F.col("doc_id") == F.col("doc"), "left")
            .select("doc_id", "label", F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
                    sig(F.coalesce("norm", F.lit(0.0)), 9).alias("norm")))


# ------------------------------------------------------------------ ML estimators (rows-only checks)

def _ratings(t):
    """Ratings with dense ids; each step is written, as the next reads it twice."""
    from ..operators.iterate import cut_to_table, release, shuffles_dropped
    from ..operators.models import dense_ids
    from .relational import ratings
    with shuffles_dropped(t.spark):
        r = cut_to_table(ratings(t))
        for col in ("user", "item"):
            before, r = r, cut_to_table(dense_ids(r, col).drop(f"{col}_id"))
            release(before)
    return r


@register("tree_cls")
def tree_cls(spark, sf):
    """ML4: 10-class tree (gini, depth 5, 100 bins) on the embeddings."""
    from ..operators.models import tree_classifier
    pts = Tables(spark, sf).embeddings.select(F.col("label").cast("double").alias("label"),
                                              F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    _, err = tree_classifier(pts)
    return err


@register("tree_reg")
def tree_reg(spark, sf):
    """ML5: regression tree for the line price from quantity, discount, tax
    and the part's retail price."""
    from ..operators.models import tree_regressor
    t = Tables(spark, sf)
    d = (t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
         .select(F.col("l_extendedprice").alias("label"),
                 F.array("l_quantity", "l_discount", "l_tax", "p_retailprice").alias("features")))
    _, out = tree_regressor(d)
    return out


@register("als_fit")
def als_fit(spark, sf):
    """ML7: ALS rank 10, 3 iterations, lambda 0.01; training MSE."""
    from ..operators.models import als, score
    r = _ratings(Tables(spark, sf))
    m = als(r, rank=10, iters=3, reg=0.01)
    p = score(m, r, 0.0)  # every pair was trained on
    return p.agg(F.avg((F.col("prediction") - F.col("rating")) ** 2).alias("mse"),
                 F.count(F.lit(1)).alias("scored"))


@register("als_grid")
def als_grid(spark, sf):
    """ML8: ranks {8, 12} x lambda {0.1} x 10 iterations on the 60/20/20
    bucket split; best by validation RMSE, its test RMSE and the gain over
    the train-mean baseline."""
    from ..operators.models import als_grid as grid
    r = _ratings(Tables(spark, sf))
    b = F.col("bucket")
    return grid(r.filter(b < 6), r.filter((b >= 6) & (b < 8)), r.filter(b >= 8))


AN_ITERS, AN_REG, AN_RANKS = 2, 0.1, (1, 2)


def _als_sql(rank: int) -> str:
    """Rounds of alternating least squares unrolled, each id's system of one or
    two equations in closed form: u<rank>, v<rank> are the factors."""
    from ..operators.svdpp import _PRIME, _ROOT, start_constants
    dims = range(rank)
    start = ", ".join(f"(item % {_PRIME} + {_ROOT}) * {a} % {_PRIME} / {float(_PRIME)!r}::double f{j}"
                      for j, a in enumerate(start_constants(rank, 0, 1)))
    sums = ", ".join([f"sum(f{i} * f{j}) g{i}{j}" for i in dims for j in dims if i <= j] + [f"sum(rating * f{j}) b{j}" for j in dims])
    ridge = f"{AN_REG!r}::double * n"
    solved = f"b0 / (g00 + {ridge}) f0" if rank == 1 else (
        f"(b0 * (g11 + {ridge}) - g01 * b1) / ((g00 + {ridge}) * (g11 + {ridge}) - g01 * g01) f0,"
        f" ((g00 + {ridge}) * b1 - g01 * b0) / ((g00 + {ridge}) * (g11 + {ridge}) - g01 * g01) f1")
    half = lambda key, other, side: (f"select {key}, {solved} from (select {key}, count(*)::double n, {sums}"  # noqa: E731
                                     f" from train join {side} using ({other}) group by {key})")
    s = f""",
  v{rank}_0 as materialized (select item, {start} from (select distinct item from train))"""
    for i in range(1, AN_ITERS + 1):
        s += f""",
  u{rank}_{i} as materialized ({half('"user"', "item", f"v{rank}_{i - 1}")}),
  v{rank}_{i} as materialized ({half("item", '"user"', f"u{rank}_{i}")})"""
    dot = " + ".join(f"u.f{j} * v.f{j}" for j in dims)
    return s + f""",
  p{rank} as materialized (select r.*, coalesce({dot}, mu) prediction from ratings r
     left join u{rank}_{AN_ITERS} u on u."user" = r."user" left join v{rank}_{AN_ITERS} v on v.item = r.item, mean)"""


def _als_with(*ranks: int) -> str:
    from .relational import _RATINGS_SQL
    return _RATINGS_SQL + """, train as materialized (select * from ratings where split = 'train'),
  mean as materialized (select avg(rating) mu from ratings where split <> 'test')""" + "".join(_als_sql(r) for r in ranks)


def _splits(spark, sf):
    from ..operators.iterate import cut_to_table
    from .relational import ratings
    r = cut_to_table(ratings(Tables(spark, sf)))
    b = F.col("bucket")
    return r.filter(b < 6), r.filter((b >= 6) & (b < 8)), r.filter(b >= 8)


@register("als_normal_predict", _als_with(2) + """
select "user", item, rating, round(prediction, 6) prediction from p2 where split = 'test'""")
def als_normal_predict(spark, sf):
    """ML7 / JN6: ALS by normal equations (rank 2) on the train split; every
    test rating with its prediction, the mean for unseen ids."""
    from ..operators.als import als_normal, score_factors
    train, valid, test = _splits(spark, sf)
    users, items = als_normal(train, 2, AN_ITERS, AN_REG)
    mu = train.unionByName(valid).agg(F.avg("rating")).first()[0]
    p = score_factors(test.select("user", "item", "rating"), users, items, 2, mu)
    return p.withColumn("prediction", F.round("prediction", 6))


@register("als_normal_grid", _als_with(*AN_RANKS) + f""",
  e as (select *, sqrt(v1 / n_valid) valid_rmse from (
     {" union all ".join(f"select {r}::int rank, count(*) filter (where split = 'validation') n_valid, count(*) filter (where split = 'test') n_test, sum((prediction - rating) ** 2) filter (where split = 'validation') v1, sum((prediction - rating) ** 2) filter (where split = 'test') t1 from p{r}" for r in AN_RANKS)})),
  base as (select sqrt(avg((rating - mu) ** 2)) b from ratings, mean where split = 'test'),
  f as (select *, row_number() over (order by valid_rmse, rank) = 1 best from e, base)
select rank, {AN_REG!r}::double reg, {AN_ITERS}::int iters, n_valid, round(valid_rmse, 7) valid_rmse, best,
  case when best then n_test end n_test, case when best then round(sqrt(t1 / n_test), 7) end test_rmse,
  case when best then round((b - sqrt(t1 / n_test)) / b * 100, 5) end improvement_pct from f""")
def als_normal_grid(spark, sf):
    """ML8: ranks {1, 2} of ALS by normal equations on the 60/20/20 split, best
    by validation error, its test error and the gain over the mean."""
    from ..operators.als import als_search
    g = als_search(*_splits(spark, sf), AN_RANKS, (AN_REG,), (AN_ITERS,))
    return g.withColumns({"valid_rmse": F.round("valid_rmse", 7), "test_rmse": F.round("test_rmse", 7),
                          "improvement_pct": F.round("improvement_pct", 5)})


KP_ROUNDS, KP_SEED = 5, 127


def _draw_sql(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 12))::bigint::double / {float(16 ** 12)!r}::double)"


def _seeding_sql() -> str:
    """K-means|| unrolled: g<i> the candidates after round i, w their weights,
    q<j> the j-th centre drawn from them."""
    dist = "round(sum((p.x - c.x) * (p.x - c.x)), 9)"
    s = f"""
  g0 as materialized (select vec_id id from embeddings order by {_draw_sql(f"'{KP_SEED}:0:' || vec_id")}, vec_id limit 1)"""
    for i in range(KP_ROUNDS + 1):
        s += f""",
  n{i} as materialized (select id, min(d) d, arg_min(cid, (d, cid)) cid from (select p.id, c.id cid, {dist} d
     from p join p c on c.j = p.j and c.id in (select id from g{i}) group by p.id, c.id) z group by id)"""
        if i < KP_ROUNDS:
            s += f""",
  g{i + 1} as materialized (select id from g{i} union select id from n{i}
     where {_draw_sql(f"'{KP_SEED}:{i + 1}:' || id")} < {2.0 * K!r}::double * d / (select sum(d::decimal(28,9))::double from n{i}))"""
    s += f""",
  w as materialized (select g.id, count(n.id)::double w from g{KP_ROUNDS} g left join n{KP_ROUNDS} n on n.cid = g.id group by g.id),
  dd as materialized (select p.id, c.id cid, {dist} d from p join p c on c.j = p.j
     where p.id in (select id from w) and c.id in (select id from w) group by p.id, c.id),
  m0 as (select id, w least, w mass from w)"""
    for j in range(K):
        after = f"least(m{j}.least, dd.d)" if j else "dd.d"
        s += f""",
  q{j} as materialized (select id from (select id, sum(mass) over (order by id) run, sum(mass) over () total from m{j})
     where run > {_draw_sql(f"'{KP_SEED}:pick:{j}'")} * total order by id limit 1),
  m{j + 1} as materialized (select id, {after} least, w * {after} mass from m{j} join w using (id) join dd using (id)
     where dd.cid = (select id from q{j}))"""
    return s + ",\n  ids as (" + " union all ".join(f"select id, {j} k from q{j}" for j in range(K)) + ")"


def _seeded(spark, sf):
    from ..operators.seeding import kmeans_parallel_init
    pts = _points(Tables(spark, sf))
    c = kmeans_parallel_init(pts, K, "vec_id", rounds=KP_ROUNDS, seed=KP_SEED)
    return pts, L.kmeans_lloyd(pts, c, KM_STEPS)


@register("kmeans_parallel", kmeans_sql(KM_STEPS, _seeding_sql()) + f"\nselect id vec_id, k cluster from a{KM_STEPS + 1}")
def kmeans_parallel(spark, sf):
    """ML10: K-means|| (k=10, seed 127, 5 rounds) and 5 Lloyd steps over the embeddings."""
    pts, c = _seeded(spark, sf)
    return L.kmeans_assign(pts, c).select("vec_id", "cluster")


@register("kmeans_parallel_cost", kmeans_sql(KM_STEPS, _seeding_sql()) +
          f"\nselect cast(printf('%.8e', sum(d)) as double) wssse from (select p.id, min(s) d from (select p.id, c.k,"
          f" sum((p.x - c.c) * (p.x - c.c)) s from p join c{KM_STEPS} c on c.j = p.j group by p.id, c.k) p group by p.id) q")
def kmeans_parallel_cost(spark, sf):
    pts, c = _seeded(spark, sf)
    return L.wssse(pts, c).select(sig("wssse", 9).alias("wssse"))


@register("pca_project")
def pca_project(spark, sf):
    """ML11: PCA fit (k=50 of the 64 embedding dimensions) + projection."""
    from ..operators.models import pca_project as pp
    _, proj = pp(_points(Tables(spark, sf)), 50)
    return proj.select("vec_id", "projected")


TREE_DEPTH, TREE_BINS = 5, 32


def _tree_sql(rows: str, kind: str) -> str:
    """Level-wise growth, unrolled; ``rows`` gives (rid, y, f, x)."""
    cost = {"class": lambda p: f"case when {p}n > 0 then {p}n - {p}q / {p}n else 0 end",
            "number": lambda p: f"case when {p}n > 0 then {p}q - {p}s * {p}s / {p}n else 0 end"}[kind]
    k = "cast(y as integer)" if kind == "class" else "0"
    s = f"""with r as materialized ({rows}),
  e as (select f, min(x) low, max(x) high from r group by f),
  b as materialized (select rid, y, {k} k, f, len(list_filter(range(1, {TREE_BINS}), lambda i: x > low + (high - low) * i / {TREE_BINS}::double)) bin from r join e using (f)),
  n0 as (select distinct rid, 1::bigint node from r)"""
    for t in range(TREE_DEPTH + 1):
        s += f""",
  h{t} as (select node, f, bin, k, count(*)::double n, sum(y)::double s, sum(y * y)::double q from b join n{t} using (rid) group by all),
  g{t} as (select * from (select distinct node, f, bin from h{t}) join (select distinct node, f, k from h{t}) using (node, f)
           left join h{t} using (node, f, bin, k)),
  c{t} as (select node, f, bin, k, sum(coalesce(n, 0)) over w ln, sum(coalesce(s, 0)) over w ls, sum(coalesce(q, 0)) over w lq,
             sum(coalesce(n, 0)) over v tn, sum(coalesce(s, 0)) over v ts, sum(coalesce(q, 0)) over v tq from g{t}
           window w as (partition by node, f, k order by bin), v as (partition by node, f, k)),
  a{t} as (select node, f, bin, sum(ln) ln, sum(ls) ls, {"sum(ln * ln)" if kind == "class" else "sum(lq)"} lq, sum(tn) tn, sum(ts) ts,
             {"sum(tn * tn)" if kind == "class" else "sum(tq)"} tq, sum(tn - ln) rn, sum(ts - ls) rs,
             {"sum((tn - ln) * (tn - ln))" if kind == "class" else "sum(tq - lq)"} rq from c{t} group by all),
  s{t} as (select *, case when ln > 0 and rn > 0 and {cost("t")} > 0
             then round(({cost("t")} - ({cost("l")}) - ({cost("r")})) / ({cost("t")}), 9) else 0 end gain from a{t}),
  v{t} as materialized (select node, f, bin, gain, tn size, {"x.k::double" if kind == "class" else "x.m"} prediction
    from (select * from s{t} qualify row_number() over (partition by node order by gain desc, f, bin) = 1)
    join (select node, {"k" if kind == "class" else "sum(s) / sum(n) m"} from h{t} where f = 0
          group by {"node, k" if kind == "class" else "node"}{" qualify row_number() over (partition by node order by sum(n) desc, k) = 1" if kind == "class" else ""}) x using (node)),
  n{t + 1} as materialized (select rid, 2 * node + case when b.bin > v.bin then 1 else 0 end node
    from n{t} join v{t} v using (node) join b using (rid, f) where gain > 1e-9)"""
    level = lambda t: f"""select node, case when {"true" if t < TREE_DEPTH else "false"} and gain > 1e-9 then f end feature,
  case when {"true" if t < TREE_DEPTH else "false"} and gain > 1e-9 then round(low + (high - low) * (bin + 1) / {TREE_BINS}::double, 9) end threshold,
  cast(size as bigint) size, round(prediction, 6) prediction from v{t} join e using (f)"""  # noqa: E731
    return s + "\n" + " union all ".join(level(t) for t in range(TREE_DEPTH + 1))


_TREE_REG_ROWS = """select rid, l_extendedprice::double y, f, x from (
  select rid, l_extendedprice, unnest([0, 1, 2, 3]) f, unnest([l_quantity::double, l_discount::double, l_tax::double, p_retailprice::double]) x
  from (select row_number() over () rid, * from lineitem join part on l_partkey = p_partkey) w) z"""  # (order and line number repeat in these tables)
_TREE_CLS_ROWS = "select vec_id rid, label::double y, unnest(range(64))::integer f, unnest(embedding)::double x from embeddings"


def _tree_rows(t: Tables, kind: str):
    if kind == "class":
        return t.embeddings.select(F.col("label").cast("double").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    return (t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("l_extendedprice").cast("double").alias("label"), F.array(*(F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax", "p_retailprice"))).alias("features")))


def _tree_nodes(rows, kind: str, dim: int, classes: int = 1):
    from ..operators import trees
    from ..operators.iterate import cut_to_table
    rows = cut_to_table(rows)
    tree = trees.grow(rows, kind, TREE_DEPTH, trees.equal_widths(rows, dim, TREE_BINS), classes)
    return tree.frame(rows.sparkSession).select("node", "feature", F.round("threshold", 9).alias("threshold"), "size", F.round("prediction", 6).alias("prediction"))


@register("tree_cls_levels", _tree_sql(_TREE_CLS_ROWS, "class"))
def tree_cls_levels(spark, sf):
    """ML4: a 10-class tree on the embeddings, grown level by level: every node
    with its split, size and prediction."""
    return _tree_nodes(_tree_rows(Tables(spark, sf), "class"), "class", 64, 10)


@register("tree_reg_levels", _tree_sql(_TREE_REG_ROWS, "number"))
def tree_reg_levels(spark, sf):
    """ML5: a regression tree for the line price, grown level by level."""
    return _tree_nodes(_tree_rows(Tables(spark, sf), "number"), "number", 4)


PCA_K, PCA_STEPS, DIMS = 3, 12, 64


def _pca_sql() -> str:
    s = f"""with p as (select vec_id, unnest(range({DIMS})) i, unnest(embedding)::double x from embeddings),
  m as (select i, avg(x) mu from p group by i),
  d as (select vec_id, i, x - mu x from p join m using (i)),
  c as materialized (select a.i, b.i j, sum(a.x * b.x) / (select count(*) - 1 from embeddings) x from d a join d b using (vec_id) group by 1, 2),
  u0 as (select 0 k, 0 i, 0.0::double x where false)"""
    for k in range(PCA_K):
        s += f",\n  w{k}_0 as (select i, 1 + i * {k + 1} / {DIMS}::double x from range({DIMS}) t(i))"
        for t in range(PCA_STEPS + 1):
            if t:
                s += f",\n  w{k}_{t} as (select c.i, sum(c.x * v.x) x from c join v{k}_{t - 1} v on v.i = c.j group by c.i)"
            w = f"w{k}_{t}"
            s += f""",\n  o{k}_{t} as (select w.i, w.x - coalesce(h.x, 0) x from {w} w left join (select u.i, sum(u.x * g.d) x from u{k} u join
    (select u.k, sum(u.x * w.x) d from u{k} u join {w} w using (i) group by u.k) g using (k) group by u.i) h using (i)),
  v{k}_{t} as materialized (select i, x / sqrt((select sum(x * x) from o{k}_{t})) x from o{k}_{t})"""
        s += f""",\n  u{k + 1} as materialized (select * from u{k} union all select {k}, i, x * sign((select x from v{k}_{PCA_STEPS} order by round(abs(x), 9) desc, i limit 1))
    from v{k}_{PCA_STEPS})"""
    return s + f"\nselect vec_id, k component, round(sum(p.x * u.x), 6) score from p join u{PCA_K} u using (i) group by vec_id, k"


@register("pca_power", _pca_sql())
def pca_power(spark, sf):
    """ML11: the first 3 principal directions of the embeddings by 12 steps of
    orthogonal iteration each, and every row's coordinates along them."""
    pts = _points(Tables(spark, sf))
    v = L.principal_components(L.covariance_matrix(pts), PCA_K, PCA_STEPS)
    return (L.project(pts, v).select("vec_id", F.posexplode("projected").alias("component", "score"))
            .select("vec_id", "component", F.round("score", 6).alias("score")))


@register("hashing_tfidf", _TFIDF_SQL.split("  m as")[0].replace("tf as (", "tf0 as (") + """
  hb as (select doc, ((""" + "cast(list_reduce(list_transform(string_split(term, ''), lambda c: cast(unicode(c) as bigint)),"
    " lambda h, c: ((h*31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, cast(0 as bigint)) as integer)"
    + """ % 1048576) + 1048576) % 1048576 bucket, sum(tf)::double tf from tf0 group by all),
  m as (select count(*) m from documents),
  df as (select bucket, count(*) df from hb group by bucket),
  x as (select hb.doc, hb.tf * case when df >= 2 then ln((m + 1.0::double) / (df + 1.0::double)) else 0.0 end tfidf
        from hb join df on df.bucket = hb.bucket, m)
select doc doc_id, count(*) filter (where tfidf <> 0) nnz, cast(printf('%.8e', sum(tfidf)) as double) l1 from x group by doc""")
def hashing_tfidf(spark, sf):
    """ML13b: hashed TF-IDF (2^20 buckets, minDocFreq 2) per document:
    non-zero buckets and L1 norm."""
    x = L.hashed_tfidf(Tables(spark, sf).documents, "doc_id", "text")
    return x.groupBy(F.col("doc").alias("doc_id")).agg(
        F.count_if(F.col("tfidf") != 0).alias("nnz"), sig(F.sum("tfidf"), 9).alias("l1"))
