"""Registered graph queries on graphs derived from the tables, with SQL
oracles (unrolled CTE chains for fixed-step loops, keyed recursive CTEs
for fixpoints)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import sig
from ..operators import graph as G
from ..operators.iterate import cut_to_table, shuffles_dropped
from ..sources.tables import Tables
from .graphs import order_part, order_part_sql, user_next, user_next_sql, view_buy, view_buy_sql

Q = {}
SQL = {}

PR_STEPS = 12
LPA_STEPS = 20
LANDMARKS = (1, 3)
SOURCE = 1


def register(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


# ---------------------------------------------------------------- oracles

def _pr_links_sql() -> str:
    return user_next_sql() + """,
  l as (select src, count(*) d from user_next group by src),
  e as (select u.src, u.dst, 1.0::double / l.d w from user_next u join l on u.src = l.src),
  v as (select src id from user_next union select dst from user_next)"""


def _pr_simple_ctes(n: int) -> str:
    s = ",\n  r0 as materialized (select src id, 1.0::double rank from l)"
    for i in range(1, n + 1):
        s += (f",\n  r{i} as materialized (select e.dst id, 0.15::double + 0.85::double * sum(r.rank * e.w) rank"
              f" from r{i-1} r join e on e.src = r.id group by e.dst)")
    return s


def _pr_static_ctes(n: int) -> str:
    s = ",\n  s0 as materialized (select id, 1.0::double rank from v)"
    for i in range(1, n + 1):
        s += (f",\n  s{i} as materialized (select v.id, 0.15::double + 0.85::double * coalesce(c.s, 0.0) rank"
              f" from v left join (select e.dst, sum(r.rank * e.w) s from s{i-1} r join e on e.src = r.id"
              f" group by e.dst) c on c.dst = v.id)")
    return s


def _lpa_ctes(n: int) -> str:
    s = user_next_sql() + """,
  b as (select src, dst from user_next union all select dst, src from user_next),
  v as (select src id from user_next union select dst from user_next),
  p0 as materialized (select id, id label from v)"""
    for i in range(1, n + 1):
        s += (f",\n  p{i} as materialized (select v.id, coalesce(x.nl, p.label) label from p{i-1} p"
              f" join v on v.id = p.id left join (select w, arg_min(label, (-c, label)) nl from"
              f" (select b.dst w, q.label, count(*) c from b join p{i-1} q on q.id = b.src"
              f" group by b.dst, q.label) y group by w) x on x.w = v.id)")
    return s


# ---------------------------------------------------------------- queries

@register("page_rank_12", _pr_links_sql() + _pr_simple_ctes(PR_STEPS) +
          f"\nselect id, round(rank, 6) rank from r{PR_STEPS}")
def page_rank_12(spark, sf):
    r = G.page_rank_simple(user_next(Tables(spark, sf)), PR_STEPS)
    return r.select("id", _r6("rank"))


@register("page_rank_static_12", _pr_links_sql() + _pr_static_ctes(PR_STEPS) +
          f"\nselect id, round(rank, 6) rank from s{PR_STEPS}")
def page_rank_static_12(spark, sf):
    r = G.page_rank_static(user_next(Tables(spark, sf)), PR_STEPS)
    return r.select("id", _r6("rank"))


@register("rank_distance", _pr_links_sql() + _pr_simple_ctes(PR_STEPS) + _pr_static_ctes(PR_STEPS) +
          f"\nselect round(sum((s.rank - coalesce(r.rank, 0.0)) * (s.rank - coalesce(r.rank, 0.0))), 6) distance"
          f" from s{PR_STEPS} s left join r{PR_STEPS} r on r.id = s.id")
def rank_distance(spark, sf):
    e = user_next(Tables(spark, sf))
    d = G.rank_distance(G.page_rank_static(e, PR_STEPS), G.page_rank_simple(e, PR_STEPS))
    return d.select(_r6("distance"))


@register("ranks_named", _pr_links_sql() + _pr_simple_ctes(PR_STEPS) +
          f"\nselect r.id, c_name name, round(rank, 6) rank from r{PR_STEPS} r join customer on c_custkey = r.id")
def ranks_named(spark, sf):
    t = Tables(spark, sf)
    r = G.page_rank_simple(user_next(t), PR_STEPS)
    return G.ranks_named(r, t.customer, "c_custkey", "c_name").select("id", "name", _r6("rank"))


@register("components", order_part_sql() + """,
  und as (select src a, dst b from order_part union all select dst, src from order_part),
  cc as (with recursive cc(v, l) using key (v) as (
     select a, least(a, min(b)) from und group by a
     union
     select u.b, min(c.l) from cc c join und u on u.a = c.v
     group by u.b having min(c.l) < (select min(r.l) from recurring.cc r where r.v = u.b))
   select * from cc)
select v id, l component from cc""")
def components(spark, sf):
    return G.connected_components(order_part(Tables(spark, sf)))


def _scc_sql(graph: str) -> str:
    return f""",
  reach as (with recursive reach(a, b) as (select src, dst from {graph}
     union select r.a, e.dst from reach r join {graph} e on e.src = r.b) select * from reach),
  v as (select src id from {graph} union select dst from {graph})
select v.id, least(v.id, coalesce(min(r1.b), v.id)) scc from v
left join reach r1 on r1.a = v.id and exists (select 1 from reach r2 where r2.a = r1.b and r2.b = v.id)
group by v.id"""


@register("scc", view_buy_sql() + _scc_sql("view_buy"))
def scc(spark, sf):
    return G.strongly_connected_components(view_buy(Tables(spark, sf)))


@register("scc_user_next", user_next_sql() + _scc_sql("user_next"))
def scc_user_next(spark, sf):
    """G7 over all steps from a user to the next one."""
    return G.strongly_connected_components(user_next(Tables(spark, sf)))


@register("lpa_20", _lpa_ctes(LPA_STEPS) + f"\nselect id, label from p{LPA_STEPS}")
def lpa_20(spark, sf):
    return G.label_propagation(user_next(Tables(spark, sf)), LPA_STEPS)


@register("landmark_hops", user_next_sql() + f""",
  v as (select src id from user_next union select dst from user_next),
  h as (with recursive h(id, landmark, hops) using key (id, landmark) as (
     select id, id, 0 from v where id in {LANDMARKS}
     union
     select e.src, h.landmark, min(h.hops + 1) from h join user_next e on e.dst = h.id
     where not exists (select 1 from recurring.h r where r.id = e.src and r.landmark = h.landmark)
     group by e.src, h.landmark)
   select * from h)
select id, landmark, hops from h""")
def landmark_hops(spark, sf):
    return G.landmark_hops(user_next(Tables(spark, sf)), list(LANDMARKS))


_SSSP_SQL = user_next_sql() + f""",
  v as (select src id from user_next union select dst from user_next),
  d as (with recursive d(id, dist) using key (id) as (
     select id, 0.0::double from v where id = {SOURCE}
     union
     select e.dst, min(d.dist + 1.0::double) from d join user_next e on e.src = d.id
     where not exists (select 1 from recurring.d r where r.id = e.dst)
     group by e.dst)
   select * from d)
select v.id, coalesce(d.dist, 'inf'::double) dist from v left join d on d.id = v.id"""


@register("sssp", _SSSP_SQL)
def q_sssp(spark, sf):
    return G.sssp(user_next(Tables(spark, sf)), SOURCE)


@register("pregel_sssp", _SSSP_SQL)
def q_pregel_sssp(spark, sf):
    return G.pregel_sssp(user_next(Tables(spark, sf)), SOURCE)


@register("triangles", user_next_sql() + """,
  und as (select distinct least(src, dst) a, greatest(src, dst) b from user_next where src <> dst),
  adj as (select a x, b y from und union all select b, a from und),
  t as (select n1.x id, count(*) c from adj n1 join adj n2 on n1.x = n2.x and n1.y < n2.y
        join und e on e.a = n1.y and e.b = n2.y group by n1.x),
  v as (select a id from und union select b from und)
select v.id, coalesce(t.c, 0) triangles from v left join t on t.id = v.id""")
def triangles(spark, sf):
    return G.triangle_count(user_next(Tables(spark, sf)))


def _svdpp_sql() -> str:
    """One step of SVD++ with a row for each vertex and component."""
    from ..operators.svdpp import _PRIME, _ROOT, SvdConf, start_constants
    from .graphs import PART_OFFSET
    from .relational import _RATINGS_SQL
    c = SvdConf()
    start = lambda salt: f"(id % {_PRIME} + {_ROOT}) * {start_constants(c.rank, 0, salt)}[k + 1] % {_PRIME} / {float(_PRIME)!r}::double"
    g1, g2, g6, g7 = (f"{g!r}::double" for g in (c.gamma1, c.gamma2, c.gamma6, c.gamma7))
    err = lambda v, s: (f"select e.i, src, dst, r - least(greatest(u + a.b + c.b + d.dot, {c.min_val!r}::double), {c.max_val!r}::double) err from e"  # noqa: E731
                        f" join (select e.i, sum(q.v1 * z.v2) dot from e join {v} z on z.id = e.src join {v} q on q.id = e.dst and q.k = z.k group by e.i) d using (i)"
                        f" join {s} a on a.id = src join {s} c on c.id = dst, mu")
    return _RATINGS_SQL + f""",
  e as materialized (select row_number() over () i, "user"::bigint src, (item + {PART_OFFSET})::bigint dst, rating::double r from ratings),
  mu as materialized (select avg(r) u from e),
  s as materialized (select id, sum(r) / count(*) - any_value(u) b, 1.0::double / sqrt(count(*)) n, count(*)::double deg
     from (select src id, r from e union all select dst, r from e), mu group by id),
  v as materialized (select id, k, {start(1)} v1, {start(2)} v2 from s, range({c.rank}) t(k)),
  ys as materialized (select src id, k, sum(v2) y from e join v on v.id = dst group by all),
  z as materialized (select v.id, v.k, v1, case when y is null then v2 else v1 + n * y end v2 from v join s using (id) left join ys using (id, k)),
  x as materialized ({err("z", "s")}),
  m as materialized (select src id, q.k k, {g2} * (sum(err * q.v1) - {g7} * any_value(p.v1) * count(*)) m1,
       {g2} * (any_value(s.n) * sum(err * q.v1) - {g7} * sum(q.v2)) m2
     from x join z q on q.id = dst join z p on p.id = src and p.k = q.k join s on s.id = src group by src, q.k
     union all
     select dst, p.k, {g2} * (sum(err * p.v2) - {g7} * any_value(q.v1) * count(*)),
       {g2} * (any_value(q.v1) * sum(err * s.n) - {g7} * any_value(q.v2) * count(*))
     from x join z p on p.id = src join z q on q.id = dst and p.k = q.k join s on s.id = src group by dst, p.k),
  s1 as materialized (select s.id, b + coalesce({g1} * (es - {g6} * b * c), 0) b from s left join
     (select id, sum(err) es, count(*) c from (select src id, err from x union all select dst, err from x) group by id) using (id)),
  v1 as materialized (select id, k, z.v1 + m1 v1, z.v2 + m2 v2 from z join m using (id, k)),
  y as materialized ({err("v1", "s1")})
select cast(printf('%.8e', sum(err * err) / count(*)) as double) mse, cast(printf('%.8e', any_value(u)) as double) mean, count(*) edges from y, mu"""


@register("svdpp", _svdpp_sql())
def svdpp(spark, sf):
    """SVD++ (rank 50, 1 iteration, gammas 0.007/0.007/0.005/0.015,
    predictions clamped to [0, 5]) on customer→part ratings (quantity/10);
    reports the training mean squared error as the reference does."""
    from ..operators.svdpp import SvdConf, svd_plus_plus, training_error
    from .graphs import PART_OFFSET
    from .relational import ratings
    with shuffles_dropped(spark):
        r = cut_to_table(ratings(Tables(spark, sf)).select(F.col("user").alias("src"),
                                                           (F.col("item") + F.lit(PART_OFFSET)).alias("dst"), "rating"))
    v, u = svd_plus_plus(r, SvdConf())
    n = r.agg(F.count(F.lit(1)).alias("edges"))
    return training_error(v, r, F.col("id") >= PART_OFFSET).select(
        sig("mse", 9).alias("mse"), sig(F.lit(u), 9).alias("mean"), n.scalar().alias("edges"))


def _pr_dynamic_sql(max_steps: int = 200, tol: float = 1e-6) -> str:
    """Dynamic PageRank unrolled: step i computes the static update of step
    i-1 unless the change of step i-1 was already within ``tol`` (then the
    state is carried unchanged)."""
    s = _pr_links_sql() + ",\n  d0 as materialized (select id, 1.0::double rank, false done from v)"
    for i in range(1, max_steps + 1):
        s += (f",\n  c{i} as materialized (select v.id, 0.15::double + 0.85::double * coalesce(x.s, 0.0) rank"
              f" from v left join (select e.dst, sum(r.rank * e.w) s from d{i-1} r join e on e.src = r.id"
              f" group by e.dst) x on x.dst = v.id)"
              f",\n  d{i} as materialized (select p.id, case when p.done then p.rank else c.rank end rank,"
              f" p.done or (select max(abs(c2.rank - p2.rank)) from c{i} c2 join d{i-1} p2 on p2.id = c2.id)"
              f" <= {tol!r} done from d{i-1} p join c{i} c on c.id = p.id)")
    return s + f"\nselect id, round(rank, 6) rank from d{max_steps}"


@register("page_rank_dynamic", _pr_dynamic_sql())
def page_rank_dynamic(spark, sf):
    """Static-form PageRank iterated until no rank moves by more than
    1e-6 (rows-checked; the tests compare its limit with many static steps)."""
    r = G.page_rank_until(user_next(Tables(spark, sf)), tol=1e-6)
    return r.select("id", _r6("rank"))
