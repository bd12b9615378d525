"""Standard graphs derived from the shared tables, as Spark
plans and as DuckDB SQL.

All derivations are linear in the input: equi-joins on unique keys and
aggregates, never all pairs inside a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Tables


def user_next(t: Tables) -> DataFrame:
    """``user_id -> user_id of the next event`` (events are numbered densely
    in time order), distinct, self-loops dropped.

    The successor is found by an equi-join on ``event_id + 1`` (a unique
    key), so the work spreads over all partitions instead of a global
    ordered window in one task.
    """
    e = t.events.select("event_id", "user_id")
    a, b = e.alias("a"), e.alias("b")
    return (a.join(b, F.col("b.event_id") == F.col("a.event_id") + 1)
            .select(F.col("a.user_id").alias("src"), F.col("b.user_id").alias("dst"))
            .filter(F.col("src") != F.col("dst"))
            .distinct())


def user_next_sql() -> str:
    return """with user_next as (select distinct a.user_id src, b.user_id dst from events a
      join events b on b.event_id = a.event_id + 1 where a.user_id <> b.user_id)"""


def view_buy(t: Tables) -> DataFrame:
    """``user_next`` restricted to steps from a view to a purchase: a sparse
    directed graph with non-trivial strongly connected components."""
    e = t.events.select("event_id", "user_id", "event_type")
    a, b = e.alias("a"), e.alias("b")
    return (a.filter(F.col("event_type") == "view")
            .join(b.filter(F.col("event_type") == "purchase"),
                  F.col("b.event_id") == F.col("a.event_id") + 1)
            .select(F.col("a.user_id").alias("src"), F.col("b.user_id").alias("dst"))
            .filter(F.col("src") != F.col("dst"))
            .distinct())


def view_buy_sql() -> str:
    return """with view_buy as (select distinct a.user_id src, b.user_id dst from events a
      join events b on b.event_id = a.event_id + 1
      where a.event_type = 'view' and b.event_type = 'purchase' and a.user_id <> b.user_id)"""


# Part vertices are shifted so they never collide with order ids.
PART_OFFSET = 1 << 40


def order_part(t: Tables, flag: str | None = None, min_qty: float | None = None) -> DataFrame:
    """Bipartite order–part graph: an edge per (order, part) of lineitem, or of
    its lines with ``l_returnflag = flag`` and ``l_quantity >= min_qty``.
    Parts bought in one order end up in one component without ever listing
    the pairs of parts inside the order."""
    li = t.lineitem
    if flag is not None:
        li = li.filter(F.col("l_returnflag") == flag)
    if min_qty is not None:
        li = li.filter(F.col("l_quantity") >= min_qty)
    return li.select(F.col("l_orderkey").alias("src"),
                     (F.col("l_partkey") + F.lit(PART_OFFSET)).alias("dst")).distinct()


def order_part_sql(flag: str | None = None, min_qty: float | None = None) -> str:
    where = " and ".join(["true"] + [f"l_returnflag = '{flag}'"] * (flag is not None) + [f"l_quantity >= {min_qty}"] * (min_qty is not None))
    return f"""with order_part as (select distinct l_orderkey src, l_partkey + {PART_OFFSET} dst
      from lineitem where {where})"""
