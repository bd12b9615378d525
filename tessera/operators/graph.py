"""Graph analytics on two DataFrames: ``edges(src, dst[, weight])`` and,
where needed, ``vertices(id, ...)``.

GraphX has no Python API, so every algorithm is a loop of joins and
aggregates.  Per-vertex state is small next to the edge table, which is
hash-partitioned once by its join key and persisted for the loop (the
cache keeps the partitioning), so each step shuffles only the vertex state
and the messages, never the edges.  Messages are combined map-side (partial
aggregation) before they are shuffled, which keeps high-degree vertices from
funnelling all their messages into one task.  The evolving vertex state is
cut with reliable checkpoints (``iterate.Loop``).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import Loop, cut, cut_to_table, hold, is_table, release, rounds, small_tasks

INF = float("inf")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def vertices_of(edges: DataFrame) -> DataFrame:
    return (edges.select(F.col("src").alias("id"))
            .union(edges.select(F.col("dst").alias("id"))).distinct())


def partition_edges(edges: DataFrame, n: int | None = None) -> DataFrame:
    """Vertex-cut style placement — hash on both endpoints so a hub's
    edges spread over all partitions."""
    return edges.repartition(n or _parts(edges), "src", "dst")


# --------------------------------------------------------------------------
# Loop-invariant edges, partitioned by their join key with hot keys salted
# --------------------------------------------------------------------------

class KeyedEdges:
    """An edge table held for a whole loop, hash-partitioned by its join key
    (and a salt for hot keys).

    A vertex that owns more than ~1/(2P) of the edges (P = partitions) would
    put a large share of every iteration's work in one task; its edges are
    split over ``ceil(deg / cap)`` salt buckets by a hash of the other
    endpoint, and its state row is replicated to each of its buckets when
    joined.  At most 2P vertices can be hot, so the fan-out, a broadcast table
    of hot vertices, is bounded.  The input is cut first: a lost block of the
    held table is rebuilt from written data.
    """

    EDGES_PER_PARTITION = 1_000_000

    def __init__(self, edges: DataFrame, key: str, other: str, parts: int | None = None):
        self.key = key
        if not is_table(edges):  # usually a lazy plan (a derived graph): compute it once
            edges = cut(edges)
        deg = edges.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
        total, top = deg.agg(F.sum("_c"), F.max("_c")).first()  # one pass: size and largest degree
        total, top = total or 0, top or 0
        if not parts:
            # ~1M edges per partition, at least one per core, at most the
            # configured shuffle partitions
            cores = edges.sparkSession.sparkContext.defaultParallelism
            parts = min(_parts(edges), max(cores, -(-total // self.EDGES_PER_PARTITION)))
        self.parts = parts
        cap = max(1, total // (2 * parts))
        self.fan = None
        if top > cap:
            self.fan = cut(deg.filter(F.col("_c") > cap).select(
                F.col(key).alias("_fid"), F.ceil(F.col("_c") / cap).cast("int").alias("_n")))
            e = (edges.join(F.broadcast(self.fan), F.col(key) == F.col("_fid"), "left")
                 .withColumn("_salt", F.when(F.col("_n").isNull(), F.lit(0))
                             .otherwise(F.pmod(F.xxhash64(F.col(other)), F.col("_n")).cast("int")))
                 .drop("_fid", "_n"))
            self.df = hold(e.repartition(parts, key, "_salt"))
        else:
            self.df = hold(edges.repartition(parts, key))

    def join_state(self, state: DataFrame, id_col: str = "id") -> DataFrame:
        """Inner join of the edges with per-vertex rows ``state`` on
        ``key == id_col`` (each hot vertex's rows fanned out to its salts)."""
        if self.fan is None:
            return self.df.join(state, F.col(self.key) == F.col(id_col))
        s = (state.join(F.broadcast(self.fan), F.col(id_col) == F.col("_fid"), "left")
             .withColumn("_ssalt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_n"), F.lit(1)) - 1)))
             .drop("_fid", "_n"))
        return (self.df.join(s, (F.col(self.key) == F.col(id_col)) & (F.col("_salt") == F.col("_ssalt")))
                .drop("_salt", "_ssalt"))

    def unpersist(self) -> None:
        self.df.unpersist()


# --------------------------------------------------------------------------
# PageRank family
# --------------------------------------------------------------------------

class _Links:
    """Edges held for the loop, keyed by src, and each vertex's share per
    out-edge.  The share is kept per vertex, so a hub's edges never meet its
    degree in one task."""

    def __init__(self, edges: DataFrame):
        self.edges = KeyedEdges(edges.select("src", "dst"), "src", "dst")
        self.parts = self.edges.parts
        self.share = hold(cut(self.edges.df.groupBy(F.col("src").alias("id")).agg((F.lit(1.0) / F.count(F.lit(1))).alias("w")))
                          .repartition(self.parts, "id"))

    def sums(self, ranks: DataFrame) -> DataFrame:
        """(id, s): the rank that each vertex receives along its in-edges."""
        sent = self.share.join(ranks, "id").select(F.col("id").alias("_sid"), (F.col("rank") * F.col("w")).alias("_sent"))
        return self.edges.join_state(sent, "_sid").groupBy(F.col("dst").alias("id")).agg(F.sum("_sent").alias("s"))

    def unpersist(self) -> None:
        self.edges.unpersist()
        self.share.unpersist()


def page_rank_simple(edges: DataFrame, max_iter: int = 10, damping: float = 0.85,
                     cut_every: int = 3) -> DataFrame:
    """G1: the classic example loop.  Distinct edges; rank 1.0 for every id
    with out-links; each step ``rank(v) = 0.15 + 0.85 * sum(rank(u)/outdeg(u))``
    over in-links, an inner join, so ids without in-links drop out and sinks
    pass nothing on.  ``max_iter <= 0`` means 10."""
    max_iter = max_iter if max_iter > 0 else 10
    links = _Links(edges.select("src", "dst").distinct())
    ranks = links.share.select("id", F.lit(1.0).alias("rank"))
    loop = Loop(cut_every)
    for i in range(max_iter):
        ranks = links.sums(ranks).select("id", (F.lit(1 - damping) + F.lit(damping) * F.col("s")).alias("rank"))
        ranks = loop.step(ranks, force=(i == max_iter - 1))
    links.unpersist()
    return ranks


def page_rank_static(edges: DataFrame, num_iter: int = 10, reset: float = 0.15,
                     cut_every: int = 3, start: float = 1.0) -> DataFrame:
    """Every vertex kept; ``rank = reset + (1-reset) * sum`` with a
    missing sum read as 0; start value 1.0; no final normalisation."""
    links = _Links(edges)
    verts = hold(vertices_of(edges).repartition(links.parts, "id"))
    ranks = verts.withColumn("rank", F.lit(start))
    loop = Loop(cut_every)
    for i in range(num_iter):
        ranks = _static_step(links, verts, ranks, reset)
        ranks = loop.step(ranks, force=(i == num_iter - 1))
    links.unpersist()
    verts.unpersist()
    return ranks


def _static_step(links, verts, ranks, reset):
    contrib = links.sums(ranks).withColumnRenamed("id", "cid")
    return (verts.join(contrib, verts.id == contrib.cid, "left")
            .select("id", (F.lit(reset) + F.lit(1 - reset) *
                           F.coalesce(F.col("s"), F.lit(0.0))).alias("rank")))


def page_rank_until(edges: DataFrame, tol: float = 1e-6, reset: float = 0.15,
                    max_iter: int | None = None) -> DataFrame:
    """Dynamic PageRank — iterate the static step until no vertex moves
    by more than ``tol`` (one small aggregate per step decides).  More than
    ``max_iter`` steps, where given, are an error."""
    links = _Links(edges)
    verts = hold(vertices_of(edges).repartition(links.parts, "id"))
    ranks = cut(verts.withColumn("rank", F.lit(1.0)))
    for _ in rounds(max_iter, "page_rank_until"):
        new = cut(_static_step(links, verts, ranks, reset))
        delta = (new.alias("n").join(ranks.alias("o"), "id")
                 .agg(F.max(F.abs(F.col("n.rank") - F.col("o.rank")))).first()[0])
        ranks = new
        if delta is None or delta <= tol:
            break
    links.unpersist()
    verts.unpersist()
    return ranks


def rank_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum over a's vertices of (rank_a - rank_b)^2, missing b = 0."""
    j = a.alias("a").join(b.alias("b"), F.col("a.id") == F.col("b.id"), "left")
    return j.agg(F.sum((F.col("a.rank") - F.coalesce(F.col("b.rank"), F.lit(0.0))) ** 2)
                 .alias("distance"))


def ranks_named(ranks: DataFrame, names: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Join ranks with an ``(id, name)`` side table."""
    return ranks.join(names.select(F.col(id_col).alias("id"), F.col(name_col).alias("name")), "id")


# --------------------------------------------------------------------------
# Connected components (G6): alternating large-star / small-star
# --------------------------------------------------------------------------

_SLICE = 1 << 19  # edges that a task holds at once in _forests


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex it reaches over these edges), one row a vertex.
    Every round hooks each root that has a smaller neighbour to the smallest one
    and then points all vertices at their roots, which halves the open roots."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    root = np.arange(len(ids))
    while True:
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
        if not len(a):
            return ids, ids[root]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges -> edges from each vertex to the smallest one that it reaches within
    a slice of the partition.  The forest so far counts as edges of the next slice
    until it fills half a slice, so that a task holds a slice at most."""
    def flush(held):
        u, v = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        return _forest(u, v)

    held, n = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n >= _SLICE:
            held = [flush(held)]
            n = len(held[0][0])
            if n >= _SLICE // 2:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held[0], batch.schema.types)], ["u", "v"])
                held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(flush(held), batch.schema.types)], ["u", "v"])


def connected_components(edges: DataFrame, max_iter: int | None = None) -> DataFrame:
    """Undirected components, label = smallest vertex id.

    Each task first replaces its edges, slice by slice, by a forest (every vertex
    and the smallest one it reaches there), as a partial aggregate would: at most
    one edge a vertex and slice is left, and long paths are short.  Alternating
    large-star / small-star rounds (Kiveris et al., SoCC 2014) do the rest: each
    is two aggregates and two joins over the edge list, and their number grows
    with log(n), not with the graph diameter.  Stops when the edges form stars (no
    edge ends at a vertex that itself has a smaller neighbour).  The smallest
    neighbours are cut before they are joined, so that AQE can split the root of a
    giant component, and a task's rows are few whatever the size of the graph
    (:func:`small_tasks`).  A null end is no vertex; the other end of its edge is one.
    """
    ends = edges.select(F.coalesce("src", "dst").alias("u"), F.coalesce("dst", "src").alias("v")).filter("u is not null")
    forest = cut_to_table(ends.mapInArrow(_forests, ends.schema))
    with small_tasks(edges.sparkSession, forest.count()):
        return _stars(forest, max_iter)


def _stars(forest: DataFrame, max_iter: int | None) -> DataFrame:
    """Star rounds over the forest's edges until they form stars."""
    verts = forest.select(F.col("u").alias("id")).distinct()
    e = forest.filter("u <> v")
    for _ in rounds(max_iter, "connected_components"):
        both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).union(
            e.select(F.col("v").alias("a"), F.col("u").alias("b")))
        m = cut_to_table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("ma"), F.max("b").alias("mb"),
                                               F.max(F.when(F.col("b") < F.col("a"), F.col("b"))).alias("below")))
        # stars: a vertex with a smaller neighbour has one of them, and no larger one
        if m.filter("ma < a and (mb > a or below > ma)").limit(1).count() == 0:
            break
        large = (both.filter(F.col("b") > F.col("a")).join(m.select("a", "ma"), "a")
                 .select(F.col("b").alias("u"), F.col("ma").alias("v")).distinct())
        m2 = cut_to_table(large.groupBy("u").agg(F.min("v").alias("mu")))
        small = (large.join(m2, "u").select(F.col("v").alias("x"), F.col("mu").alias("y"))
                 .union(m2.select(F.col("u").alias("x"), F.col("mu").alias("y")))
                 .filter(F.col("x") != F.col("y"))
                 .select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
                 .distinct())
        old, e = e, cut_to_table(small)
        for done in (old, m, m2):
            release(done)
    return cut_to_table(verts.join(m.select(F.col("a").alias("id"), F.col("ma").alias("component")), "id", "left")
                        .select("id", F.coalesce("component", "id").alias("component")))


# --------------------------------------------------------------------------
# Frontier BFS: landmark hops (G10) and single-source shortest paths
# --------------------------------------------------------------------------

def landmark_hops(edges: DataFrame, landmarks: list[int], max_iter: int | None = None) -> DataFrame:
    """Hop count from every vertex *to* each landmark along edge
    direction (a BFS from each landmark over reversed edges).  Unreachable
    pairs are absent.  Only the frontier moves each round."""
    rev = KeyedEdges(edges.select(F.col("dst").alias("v"), F.col("src").alias("w")).distinct(), "v", "w")
    spark = edges.sparkSession
    seed = spark.createDataFrame([(int(l), int(l)) for l in landmarks], "id long, landmark long")
    seen = cut(rev.df.select(F.col("v").alias("id")).union(rev.df.select(F.col("w").alias("id")))
               .distinct().join(seed, "id").select("id", "landmark", F.lit(0).alias("hops")))
    pieces, frontier = [seen], seen
    for d in rounds(max_iter, "landmark_hops"):
        nxt = cut(rev.join_state(frontier)
                  .select(F.col("w").alias("id"), "landmark").distinct()
                  .join(_union_all(pieces), ["id", "landmark"], "left_anti")
                  .withColumn("hops", F.lit(d + 1)))
        if nxt.limit(1).count() == 0:
            break
        pieces.append(nxt)
        if len(pieces) > 16:  # merged now and then, not rewritten every round
            pieces = [cut(_union_all(pieces))]
        frontier = nxt
    rev.unpersist()
    return _union_all(pieces)


def sssp(edges: DataFrame, source: int, weight: str | None = None,
         max_iter: int | None = None) -> DataFrame:
    """Single-source shortest paths, min-plus over ``weight`` (1.0 when
    absent), every vertex reported (infinity when unreachable).
    Bellman-Ford restricted to the vertices whose distance just improved."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = KeyedEdges(edges.select("src", "dst", w.alias("w")), "src", "dst")
    verts = vertices_of(edges)
    dist = cut(verts.select("id", F.when(F.col("id") == source, 0.0)
                            .otherwise(F.lit(INF)).alias("dist")))
    frontier = dist.filter(F.col("dist") < INF)
    for _ in rounds(max_iter, "sssp"):
        cand = (e.join_state(frontier)
                .groupBy(F.col("dst").alias("id"))
                .agg(F.min(F.col("dist") + F.col("w")).alias("cand")))
        improved = cut(cand.join(dist, "id").filter(F.col("cand") < F.col("dist"))
                       .select("id", F.col("cand").alias("dist")))
        if improved.limit(1).count() == 0:
            break
        dist = cut(dist.join(improved.withColumnRenamed("dist", "nd"), "id", "left")
                   .select("id", F.coalesce("nd", "dist").alias("dist")))
        frontier = improved
    e.unpersist()
    return dist


# --------------------------------------------------------------------------
# General Pregel loop
# --------------------------------------------------------------------------

def pregel(vertices: DataFrame, edges: DataFrame, initial_msg,
           vprog: Callable[[Column, Column], Column],
           send_to_dst: Callable[[Column, Column, Column], Column | None],
           merge: Callable[[Column], Column] = F.min,
           active: Callable[[Column, Column, Column], Column] | None = None,
           max_iter: int | None = None, reads_dst: bool = True) -> DataFrame:
    """Pregel over ``vertices(id, attr)`` and ``edges(src, dst, attr)``.

    ``vprog(attr, msg)`` → new vertex attribute; ``send_to_dst(src_attr,
    edge_attr, dst_attr)`` → message column (null = no message), optionally
    gated by ``active(...)``; ``merge`` is an aggregate over messages (min,
    sum, ...).  Super-step 0 applies ``initial_msg`` everywhere; afterwards
    only vertices that received a message are updated and only edges out of
    them send.  Stops when no message is sent.  With ``reads_dst=False`` (the
    message uses no destination attribute) no triplet is shuffled to its
    destination; only combined messages are.
    """
    e = KeyedEdges(edges.select("src", "dst", F.col("attr").alias("eattr")), "src", "dst")
    v = cut(vertices.select("id", vprog(F.col("attr"), F.lit(initial_msg)).alias("attr")))
    changed = v
    for _ in rounds(max_iter, "pregel"):
        trip = e.join_state(changed.select(F.col("id").alias("sid"), F.col("attr").alias("sattr")), "sid")
        if not reads_dst:
            trip = trip.withColumn("dattr", F.lit(None).cast(v.schema["attr"].dataType))
        else:
            trip = (trip.join(v.select(F.col("id").alias("did"), F.col("attr").alias("dattr")),
                      F.col("dst") == F.col("did")))
        msg = send_to_dst(F.col("sattr"), F.col("eattr"), F.col("dattr"))
        if active is not None:
            msg = F.when(active(F.col("sattr"), F.col("eattr"), F.col("dattr")), msg)
        msgs = (trip.select(F.col("dst").alias("id"), msg.alias("msg"))
                .filter(F.col("msg").isNotNull())
                .groupBy("id").agg(merge("msg").alias("msg")))
        msgs = cut(msgs)
        if msgs.limit(1).count() == 0:
            break
        upd = (v.join(msgs, "id").select("id", vprog(F.col("attr"), F.col("msg")).alias("attr")))
        changed = cut(upd)
        v = cut(v.join(changed.withColumnRenamed("attr", "nattr"), "id", "left")
                .select("id", F.coalesce("nattr", "attr").alias("attr")))
    e.unpersist()
    return v


def pregel_sssp(edges: DataFrame, source: int) -> DataFrame:
    """G11 written on the general Pregel loop (must equal :func:`sssp`)."""
    verts = vertices_of(edges).select("id", F.when(F.col("id") == source, 0.0)
                                      .otherwise(F.lit(INF)).alias("attr"))
    e = edges.select("src", "dst", F.lit(1.0).alias("attr"))
    out = pregel(verts, e, INF,
                 vprog=lambda attr, msg: F.least(attr, msg),
                 send_to_dst=lambda s, w, d: s + w,
                 active=lambda s, w, d: (s + w) < d,
                 merge=F.min)
    return out.select("id", F.col("attr").alias("dist"))


# --------------------------------------------------------------------------
# Label propagation (G8), strongly connected components
# --------------------------------------------------------------------------

def label_propagation(edges: DataFrame, max_steps: int = 20, cut_every: int = 5) -> DataFrame:
    """Synchronous label propagation for ``max_steps`` rounds.  Each edge
    carries labels both ways (a self-loop counts twice); the new label is
    the most frequent neighbour label, ties to the lowest label.  (Vertices
    come from the edge list, so every vertex has a neighbour.)"""
    e = edges.select("src", "dst")
    both = KeyedEdges(e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "src", "dst")
    verts = vertices_of(edges)
    lab = verts.select("id", F.col("id").alias("label"))
    loop = Loop(cut_every)
    for i in range(max_steps):
        counts = (both.join_state(lab)
                  .groupBy(F.col("dst").alias("v"), "label").agg(F.count(F.lit(1)).alias("c")))
        # every vertex has an edge and edges carry labels both ways, so every
        # vertex receives messages: the new labels need no join with the old
        # ones, and the plan between cuts stays linear
        lab = (counts.groupBy("v")
               .agg(F.max(F.struct(F.col("c"), (-F.col("label")).alias("nl"))).alias("b"))
               .select(F.col("v").alias("id"), (-F.col("b.nl")).alias("label")))
        lab = loop.step(lab, force=(i == max_steps - 1))
    both.unpersist()
    return lab


def _min_label_forward(e: DataFrame, verts: DataFrame) -> DataFrame:
    """colour(v) = smallest id that reaches v (within the given edges); the
    edges are held keyed by source for the whole propagation.  One table a
    round: every vertex, its colour and whether that moved."""
    ke = KeyedEdges(e, "src", "dst")
    col = cut_to_table(verts.select("id", F.col("id").alias("c"), F.lit(True).alias("moved")))
    while True:
        cand = (ke.join_state(col.filter("moved").select(F.col("id").alias("sid"), F.col("c").alias("sc")), "sid")
                .groupBy(F.col("dst").alias("id")).agg(F.min("sc").alias("nc")))
        old, col = col, cut_to_table(col.join(cand, "id", "left").select(
            "id", F.least("c", "nc").alias("c"), F.coalesce(F.col("nc") < F.col("c"), F.lit(False)).alias("moved")))
        release(old)
        if col.filter("moved").limit(1).count() == 0:
            ke.unpersist()
            return col


def _union_all(pieces: list[DataFrame]) -> DataFrame:
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out


def _merged(pieces: list[DataFrame], keep: DataFrame | None = None) -> list[DataFrame]:
    """The rows of some tables in one; the tables are deleted, all but ``keep``."""
    one = cut_to_table(_union_all(pieces))
    for p in pieces:
        if p is not keep:
            release(p)
    return [one]


def strongly_connected_components(edges: DataFrame, max_rounds: int | None = None,
                                  trim_passes: int | None = None) -> DataFrame:
    """Strongly connected components, label = lowest id in the component.

    Colouring algorithm: repeatedly (1) peel edges that no cycle can use: an
    end without a remaining in- or out-edge is a singleton, (2) colour each
    vertex with the smallest id that reaches it, (3) from each colour root walk
    backwards inside its colour — the vertices reached form the root's
    component.  Assigned vertices are removed with their edges and the loop
    repeats on the rest; a vertex that no round assigns is its own component.
    Trimming runs to a fixpoint by default (``trim_passes`` can end it earlier:
    colouring finds the singletons too, but needs more rounds for them).  More
    than ``max_rounds`` rounds, where given, are an error.  Every step writes
    one table and deletes the one that it replaces, so that the driver keeps
    neither plans nor lineage of earlier steps.
    """
    given = cut_to_table(edges.select("src", "dst"))
    e = cut_to_table(given.filter(F.col("src") != F.col("dst")).distinct())
    pieces: list[DataFrame] = []
    for _ in rounds(max_rounds, "strongly_connected_components"):
        # (1) trim edges that start at a vertex without in-edges or end at one without out-edges
        size = e.count()
        for _ in itertools.count() if trim_passes is None else range(trim_passes):
            before, old = size, e
            e = cut_to_table(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
                             .join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
            release(old)
            size = e.count()
            if size == before:
                break
        if size == 0:
            break
        # (2) forward colouring
        col = _min_label_forward(e, vertices_of(e))
        # (3) backward closure from each root inside its colour
        inside = cut_to_table(e.join(col.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src")
                              .join(col.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst")
                              .filter(F.col("cs") == F.col("cd"))
                              .select("src", "dst", F.col("cs").alias("c")))
        ce = KeyedEdges(inside, "dst", "src")
        frontier = cut_to_table(col.filter(F.col("id") == F.col("c")).select("id", F.col("c").alias("scc")))
        found = [frontier]
        while True:
            nxt = cut_to_table(ce.join_state(frontier)
                               .filter(F.col("c") == F.col("scc"))
                               .select(F.col("src").alias("id"), "scc").distinct()
                               .join(_union_all(found), "id", "left_anti"))
            if nxt.limit(1).count() == 0:
                break
            found.append(nxt)
            frontier = nxt
            if len(found) > 16:  # merged now and then, not rewritten every step
                found = _merged(found, frontier)
        ce.unpersist()
        pieces += _merged(found)
        done = pieces[-1].select("id")
        rest = cut_to_table(e.join(done.withColumnRenamed("id", "src"), "src", "left_anti")
                            .join(done.withColumnRenamed("id", "dst"), "dst", "left_anti"))
        for old in (e, col, inside, frontier, nxt):
            release(old)
        e = rest
        if len(pieces) > 16:
            pieces = _merged(pieces)
    out = vertices_of(given)
    if not pieces:
        return out.select("id", F.col("id").alias("scc"))
    return out.join(_union_all(pieces), "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))


# --------------------------------------------------------------------------
# Triangle counting
# --------------------------------------------------------------------------

def triangle_count(edges: DataFrame) -> DataFrame:
    """Triangles through each vertex of the undirected simple graph
    (duplicates and self-loops removed).

    Edges are oriented from lower to higher (degree, id) rank, which bounds
    every vertex's out-degree by sqrt(2m); the wedge join u→v→w then has at
    most O(m^1.5) rows no matter how skewed the degrees are, and a hub's
    many in-edges meet only its few out-edges.  Degrees are cut before they
    are joined to the edges, so that AQE can split a hub's partition.
    """
    und = (edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
           .filter(F.col("a") != F.col("b")).distinct())
    und = cut(und)
    deg = cut(und.select(F.col("a").alias("id")).union(und.select(F.col("b").alias("id")))
              .groupBy("id").agg(F.count(F.lit(1)).alias("d")))
    ranked = (und.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a")
              .join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b"))
    a_first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    o = cut(ranked.select(F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("x"),
                          F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("y")))
    e1, e2, e3 = o.alias("e1"), o.alias("e2"), o.alias("e3")
    tri = (e1.join(e2, F.col("e1.y") == F.col("e2.x"))
           .join(e3, (F.col("e3.x") == F.col("e1.x")) & (F.col("e3.y") == F.col("e2.y")))
           .select(F.col("e1.x").alias("u"), F.col("e1.y").alias("v"), F.col("e2.y").alias("w")))
    per_vertex = (tri.select(F.explode(F.array("u", "v", "w")).alias("id"))
                  .groupBy("id").agg(F.count(F.lit(1)).alias("triangles")))
    return (deg.select("id").join(per_vertex, "id", "left")
            .select("id", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles")))


# --------------------------------------------------------------------------
# Generators
# --------------------------------------------------------------------------

def two_cliques(spark, n: int) -> DataFrame:
    """Clique on 0..n-1 and clique on n..2n (n+1 vertices), every ordered
    pair including self-loops, plus the bridge 0→n.  Built by exploding a
    sequence per vertex (no cross join)."""
    a = (spark.range(0, n).select(F.col("id").alias("src"))
         .select("src", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("dst")))
    b = (spark.range(n, 2 * n + 1).select(F.col("id").alias("src"))
         .select("src", F.explode(F.sequence(F.lit(n).cast("long"), F.lit(2 * n).cast("long"))).alias("dst")))
    bridge = spark.createDataFrame([(0, n)], "src long, dst long")
    return a.union(b).union(bridge)


def check_cliques(labels: DataFrame, n: int) -> DataFrame:
    """G9 checks: clique 1 uniform, clique 2 uniform, and the two differ."""
    c1 = labels.filter(F.col("id") < n)
    c2 = labels.filter(F.col("id") >= n)
    return (labels.agg(
        (F.count_distinct(F.when(F.col("id") < n, F.col("label"))) == 1).alias("b1"),
        (F.count_distinct(F.when(F.col("id") >= n, F.col("label"))) == 1).alias("b2"),
        (F.min(F.when(F.col("id") < n, F.col("label"))) !=
         F.min(F.when(F.col("id") >= n, F.col("label")))).alias("b3")))


def lognormal_graph(spark, num_vertices: int, mu: float = 4.0, sigma: float = 1.3,
                    seed: int = 42, partitions: int | None = None) -> DataFrame:
    """Out-degree ~ floor(exp(N(mu, sigma))) per vertex, destinations
    uniform; ``(src, dst, attr=1)``.  Fully distributed (range + explode)."""
    v = spark.range(0, num_vertices, numPartitions=partitions or _parts(spark.range(1)))
    deg = F.floor(F.exp(F.lit(mu) + F.lit(sigma) * F.randn(seed))).cast("long")
    out = v.select(F.col("id").alias("src"), deg.alias("deg")).filter(F.col("deg") > 0)
    out = out.select("src", F.explode(F.sequence(F.lit(1).cast("long"), F.col("deg"))).alias("k"))
    dst = F.floor(F.rand(seed + 1) * num_vertices).cast("long")
    return out.select("src", dst.alias("dst"), F.lit(1).alias("attr"))
