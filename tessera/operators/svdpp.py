"""SVD++ (G14): biased matrix factorisation with implicit feedback
(Koren, KDD 2008) trained by gradient steps over the rating edges, in the
vertex-centric form of the graph library the reference calls.

State per vertex ``(id, v1, v2, b, n)``: for a user v1 = p (factors), v2 =
p + |N(u)|^-1/2 * sum of its items' y; for an item v1 = q, v2 = y; b the
bias; n = |N|^-1/2 (after the final error pass, an item's n holds the sum of
its squared training errors).

The edges lie in a grid of cells, a block of users by a block of items; a task does
one cell.  A step sends a vertex's vector once to each cell where it has edges, not
once with each edge, and gets back a sum for each vertex and cell.  The task holds its
users and reads items and edges in the order of the items, so that few blocks of users
are enough.  Columns of the grid are done a few at a time, and what they shuffled is
dropped before the next ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import cut_to_table as cut
from .iterate import is_table, release, shuffles_dropped


@dataclass
class SvdConf:
    # The benchmark's SVD++ configuration (rank, iterations,
    # prediction clamp, learning rates gamma1/gamma2 and regularisation
    # gamma6/gamma7).
    rank: int = 50
    max_iters: int = 1
    min_val: float = 0.0
    max_val: float = 5.0
    gamma1: float = 0.007
    gamma2: float = 0.007
    gamma6: float = 0.005
    gamma7: float = 0.015


_PRIME = (1 << 31) - 1  # modulus of the initial factors' congruences
_ROOT = 48271           # a primitive root of it


def start_constants(rank: int, seed: int, salt: int) -> list[int]:
    """One multiplier a component; see :func:`_start`."""
    return [pow(_ROOT, ((2 * seed + salt) * rank + k) * 2 + 1, _PRIME) for k in range(rank)]


def _start(id_col: Column, rank: int, seed: int, salt: int) -> Column:
    """Initial factors in [0, 1): ``(id + 48271) * a_k mod p / p`` for
    component k, whole-number arithmetic that any engine repeats exactly."""
    base = F.pmod(id_col.cast("long"), F.lit(_PRIME)) + F.lit(_ROOT)
    return F.array(*[base * F.lit(a) % F.lit(_PRIME) / F.lit(float(_PRIME)) for a in start_constants(rank, seed, salt)])


def _dot(a: Column, b: Column) -> Column:
    """Dot product of two array columns on Arrow batches."""
    def task(x, y):
        import numpy as np
        import pyarrow as pa
        if not len(x):
            return pa.array([], pa.float64())
        u, v = (c.flatten().to_numpy().reshape(len(c), -1) for c in (x, y))
        return pa.array(np.einsum("ij,ij->i", u, v))

    return F.arrow_udf(task, "double")(a, b)


_WIDTH = 10  # components that one row of an aggregate sums


def _sums(df: DataFrame, vectors: list[str], scalars: list[str], rank: int) -> DataFrame:
    """Per id, the sums of the vectors, element by element, and of the scalars,
    where each row is shuffled once.

    A row becomes one for every ``_WIDTH`` components: an aggregate of a few
    sums is compiled to machine code, one of a hundred sums is not.
    """
    blocks = -(-rank // _WIDTH)
    x = df.repartition("id").withColumn("_at", F.explode(F.array(*[F.lit(i) for i in range(blocks)])))
    aggs = [F.sum(F.get(F.col(n), F.col("_at") * F.lit(_WIDTH) + F.lit(j))).alias(f"{n}_{j}")
            for n in vectors for j in range(_WIDTH)]
    g = x.groupBy("id", "_at").agg(*aggs, *[F.sum(n).alias(n) for n in scalars])
    rows = F.array_sort(F.collect_list(F.struct(
        "_at", *scalars, *[F.array(*[F.col(f"{n}_{j}") for j in range(_WIDTH)]).alias(n) for n in vectors])))
    g = g.groupBy("id").agg(rows.alias("_rows"))
    return g.select("id", *[F.col("_rows")[0][n].alias(n) for n in scalars],
                    *[F.slice(F.flatten(F.col(f"_rows.{n}")), 1, rank).alias(n) for n in vectors])


_BLOCK = 500_000    # users of a block, on average: what bounds a task's memory
_EDGES = 8_000_000  # edges of a cell, on average; down to a 16th where cores would be idle

_OUT = {"ys": "id long, ys array<double>",
        "step": "id long, c double, ci double, es double, en double, w1 array<double>, w2 array<double>",
        "error": "id long, se double"}


def _cell(what: str, mean: float | None, conf: SvdConf, seed: int, both: bool):
    """Arrow function of a cell's rows ``(src, dst, x, vec)``: first its users (no
    dst; vec is b, n and v2), then, ordered by dst, each item (no src; vec is b and a
    vector) before its edges with their rating x.  A vector that is left out is still
    at its start, as is that of an item without a row.

    * ``ys`` (items with v2): each user's sum of its items' v2;
    * ``step`` (items with v1): for users and items the edges c, those as item ci, the
      errors es, en = sum of err * n, w1 = sum of err * the other end's vector; if
      ``both`` (items with v1 and v2), for users also w2 = n * w1 - gamma7 * sum of
      the items' v2;
    * ``error`` (items with v1): each item's sum of squared errors.

    An item's sums may come in parts.  An edge without a rating has no error, but is
    counted.
    """
    rank, lo, hi, g7 = conf.rank, conf.min_val, conf.max_val, conf.gamma7
    prime, root = _PRIME, _ROOT
    starts = {salt: start_constants(rank, seed, salt) for salt in (1, 2)}
    item_salt = 2 if what == "ys" else 1

    def task(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def numbers(col):
            return pc.fill_null(col, float("nan")).to_numpy(zero_copy_only=False)

        def start(ids, salt):
            return (ids % prime + root)[:, None] * np.array(starts[salt]) % prime / float(prime)

        def unpacked(col, heads):
            """Rows' leading numbers, the vectors after them and which rows have these."""
            size = pc.list_value_length(col).to_numpy(zero_copy_only=False)
            at, flat = np.cumsum(size) - size, numbers(col.flatten())
            known = size > heads
            wide = int(size.max(initial=heads)) - heads
            return [flat[at + i] for i in range(heads)], flat[at[known][:, None] + heads + np.arange(wide)], known

        def groups(keys):
            """Order that puts equal keys together, the place of each group's first, the keys."""
            order = np.argsort(keys, kind="stable")
            k = keys[order]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][:len(k)])
            return order, first, k[first]

        def lists(m):
            return pa.ListArray.from_arrays(np.arange(0, m.size + 1, rank, dtype=np.int32), m.reshape(-1))

        def batch(**columns):
            return pa.RecordBatch.from_pydict(columns)

        read, z, n_read, users, last = [], np.empty((0, rank)), 0, None, None

        for t in batches:
            first = t.column("dst").null_count
            if first:  # the block's users, in order of id
                u = t.slice(0, first)
                ids, (b, n), vec, known = u.column("src").to_numpy().copy(), *unpacked(u.column("vec"), 2)  # a copy lets the batch go
                read.append((ids, b, n))
                if what != "ys":
                    at, n_read = n_read, n_read + first
                    if n_read > len(z):
                        z.resize((n_read + n_read // 4, rank), refcheck=False)  # in place: a task never holds two copies
                    if known.any():
                        z[at:n_read][known] = vec
                    z[at:n_read][~known] = start(ids[~known], 2)
                t = t.slice(first)
            if not len(t):
                continue
            if users is None:
                users = {k: np.concatenate([r[i] for r in read]) for i, k in enumerate(("id", "b", "n"))}
                sums = {"ys": ["y"], "step": ["w1", "y"] if both else ["w1"], "error": []}[what]
                users |= {k: np.zeros((len(users["id"]), rank)) for k in sums} | {k: np.zeros(len(users["id"])) for k in ("c", "es")}
            dst, is_edge = t.column("dst").to_numpy(), t.column("src").is_valid().to_numpy(zero_copy_only=False)
            begin = np.r_[True, dst[1:] != dst[:-1]]
            of, at = np.cumsum(begin) - 1, np.flatnonzero(begin)
            ids = dst[at]
            own = ~is_edge[at]  # the item's own row is in this batch
            (bias,), vec, known = unpacked(t.column("vec").filter(pa.array(~is_edge)), 1)
            b = np.full(len(ids), np.nan)
            b[own] = bias
            q = start(ids, item_salt)
            y = start(ids, 2) if both else None
            rows = np.flatnonzero(own)[known]
            if len(rows):
                q[rows] = vec[:, :rank]
                if both:
                    y[rows] = vec[:, rank:]
            if not own[0] and last is not None and last[0] == ids[0]:  # the last batch's last item goes on
                b[0], q[0] = last[1:3]
                if both:
                    y[0] = last[3]
            last = (ids[-1], b[-1], q[-1].copy(), y[-1].copy() if both else None)
            if not is_edge.any():
                continue

            d = of[is_edge]
            s = np.searchsorted(users["id"], t.column("src").filter(pa.array(is_edge)).to_numpy())
            by_user, us, u = groups(s)
            if what == "ys":
                users["y"][u] += np.add.reduceat(q[d[by_user]], us)
                continue
            x = t.column("x").filter(pa.array(is_edge))
            rated, zs, qd = x.is_valid().to_numpy(zero_copy_only=False), z[s], q[d]
            pred = np.full(len(s), np.nan) if mean is None else mean + users["b"][s] + b[d]
            pred += np.einsum("ij,ij->i", zs, qd)
            # a prediction that is not a number counts as the largest, as in least(greatest())
            err = np.where(rated, numbers(x) - np.fmin(np.maximum(pred, lo), hi), 0.0)
            i_at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            i, ci = d[i_at], np.diff(np.r_[i_at, len(d)]).astype(float)
            if what == "error":
                any_rated = np.add.reduceat(rated.astype(int), i_at) > 0
                yield batch(id=ids[i][any_rated], se=np.add.reduceat(err * err, i_at)[any_rated])
                continue
            users["c"][u] += np.diff(np.r_[us, len(s)])
            users["es"][u] += np.add.reduceat(err[by_user], us)
            users["w1"][u] += np.add.reduceat((err[:, None] * qd)[by_user], us)
            if both:
                users["y"][u] += np.add.reduceat(y[d[by_user]], us)
            yield batch(id=ids[i], c=ci, ci=ci, es=np.add.reduceat(err, i_at), en=np.add.reduceat(err * users["n"][s], i_at),
                        w1=lists(np.add.reduceat(err[:, None] * zs, i_at)), w2=pa.nulls(len(i), pa.list_(pa.float64())))

        if users is not None and what != "error":
            for at in range(0, len(users["id"]), 10_000):
                u = {k: m[at:at + 10_000] for k, m in users.items()}
                if what == "ys":
                    yield batch(id=u["id"], ys=lists(u["y"]))
                else:
                    none = np.zeros(len(u["id"]))
                    w2 = lists(u["n"][:, None] * u["w1"] - g7 * u["y"]) if both else pa.nulls(len(none), pa.list_(pa.float64()))
                    yield batch(id=u["id"], c=u["c"], ci=none, es=u["es"], en=none, w1=lists(u["w1"]), w2=w2)

    return task


def svd_plus_plus(edges: DataFrame, conf: SvdConf = SvdConf(), seed: int = 0):
    """Train on ``edges(src=user, dst=item, rating)``; returns
    ``(vertices, mean)`` where vertices is ``(id, v1, v2, b, n)``.

    A vector that no step has changed yet is kept as null and computed from the
    id where it is used, so it is neither written nor sent.
    """
    with shuffles_dropped(edges.sparkSession):
        return _trained(edges, conf, seed)


def _trained(edges: DataFrame, conf: SvdConf, seed: int):
    r, given = conf.rank, edges
    edges = edges.select("src", "dst", F.col("rating").cast("double").alias("r"))
    e = edges if is_table(given) else cut(edges)
    u, n_edges, n_users, n_items = e.agg(F.avg("r"), F.count(F.lit(1)), F.approx_count_distinct("src"),
                                         F.approx_count_distinct("dst")).first()
    gu = max(1, -(-n_users // _BLOCK))
    cores = e.sparkSession.sparkContext.defaultParallelism
    cells = max(-(-n_edges // _EDGES), min(cores, n_edges // max(1, _EDGES // 16)))
    gi = max(1, min(n_items, -(-cells // gu)))
    some = max(1, cores // gu)  # columns done at once: as many as give every core a cell

    def block(c: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(blocks)).cast("int")

    def row(cell: Column, src=None, dst=None, x=None, vec: Column | None = None) -> list[Column]:
        numbers = {"src": (src, "long"), "dst": (dst, "long"), "x": (x, "double")}
        empty = F.array().cast("array<double>")  # not null: Spark looks at all nulls before a row to size an Arrow batch
        return [cell.alias("cell"), *[(F.lit(None) if c is None else F.col(c)).cast(t).alias(k) for k, (c, t) in numbers.items()],
                (empty if vec is None else vec).alias("vec")]

    def packed(numbers: list[str], vectors: list[Column]) -> Column:
        return F.concat(F.array(*numbers), *[F.coalesce(c, F.array().cast("array<double>")) for c in vectors])

    pairs = e.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())

    def work(rows: DataFrame, n: int, what: str, both: bool) -> DataFrame:
        rows = rows.repartitionById(n, "cell").sortWithinPartitions(F.asc_nulls_first("dst"), F.asc_nulls_first("src"))
        return rows.drop("cell").mapInArrow(_cell(what, u, conf, seed, both), _OUT[what])

    def column(v: DataFrame, low: int, what: str, items: list[Column], both: bool) -> DataFrame:
        """What the cells of ``some`` columns from ``low`` on return."""
        n = min(some, gi - low)
        here = lambda c: (c >= low) & (c < low + n)
        cell = lambda of_user, of_item: of_user * F.lit(n) + of_item - F.lit(low)
        to, mine = F.col("_to"), block("id", gi)
        users = v.withColumn("_to", F.explode("to_items")).filter(here(to))
        rows = (pairs.filter(here(block("dst", gi))).select(*row(cell(block("src", gu), block("dst", gi)), "src", "dst", "r"))
                .unionByName(users.select(*row(cell(block("id", gu), to), src="id",
                                               vec=packed(["b", "n"], [] if what == "ys" else [F.col("v2")]))))
                .unionByName(v.filter(here(mine)).withColumn("_to", F.explode("to_users")).select(
                    *row(cell(to, mine), dst="id", vec=packed(["b"], items)))))
        return work(rows, gu * n, what, both)

    def summed(v: DataFrame, what: str, items: list[Column], vectors: list[str], scalars: list[str], both: bool = False):
        """Sums of all columns by id, and the tables they lie in."""
        parts = [cut(_sums(column(v, low, what, items, both), vectors, scalars, r)) for low in range(0, gi, some)]
        if len(parts) == 1:
            return parts[0], parts
        all_parts = parts[0]
        for p in parts[1:]:
            all_parts = all_parts.unionByName(p)
        return _sums(all_parts, vectors, scalars, r), parts

    def reached(end: str, other: Column, name: str) -> DataFrame:
        """The blocks of the other side where a vertex has edges."""
        p = pairs.select(F.col(end).alias("id"), other.alias("_to")).distinct()
        return p.groupBy("id").agg(F.collect_list("_to").alias(name))

    ends = e.select(F.col("src").alias("id"), "r").union(e.select(F.col("dst").alias("id"), "r"))
    t0 = ends.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.sum("r").alias("s"))
    none = F.lit(None).cast("array<double>")
    v = cut(t0.join(reached("src", block("dst", gi), "to_items"), "id", "left")
            .join(reached("dst", block("src", gu), "to_users"), "id", "left")
            .select("id", none.alias("v1"), none.alias("v2"), (F.col("s") / F.col("c") - F.lit(u)).alias("b"),
                    (F.lit(1.0) / F.sqrt(F.col("c"))).alias("n"), "to_items", "to_users"))
    v1 = F.coalesce("v1", _start(F.col("id"), r, seed, 1))
    v2 = F.coalesce("v2", _start(F.col("id"), r, seed, 2))
    both = not v.filter(F.col("to_items").isNotNull() & F.col("to_users").isNotNull()).isEmpty()

    g1, g2, g6, g7 = (F.lit(g) for g in (conf.gamma1, conf.gamma2, conf.gamma6, conf.gamma7))
    c, ci, en = F.col("c"), F.col("ci"), F.col("en")
    for i in range(conf.max_iters):
        # phase 1: users' v2 = p + n * sum of their items' y; the items' start takes
        # no vectors, so that a user's edges may all lie in one cell
        if i == 0:
            of = block("src", gu * gi)
            rows = pairs.select(*row(of, "src", "dst")).unionByName(v.filter(F.col("to_items").isNotNull()).select(
                *row(block("id", gu * gi), src="id", vec=packed(["b", "n"], []))))
            ysum, parts = work(rows, gu * gi, "ys", False), []
        else:
            ysum, parts = summed(v, "ys", [F.col("v2")], ["ys"], [])
        before = v
        v = cut(v.join(ysum, "id", "left").select(
            "id", "v1", F.coalesce(F.zip_with(v1, "ys", lambda p, y: p + F.col("n") * y), F.col("v2")).alias("v2"),
            "b", "n", "to_items", "to_users"))
        for old in (before, *parts):
            release(old)
        # phase 2: gradients, summed on the users and on the items
        grad, parts = summed(v, "step", [v1, v2] if both else [F.col("v1")], ["w1", "w2"] if both else ["w1"],
                             ["c", "ci", "es", "en"], both)
        if both:
            m2 = F.zip_with("w2", v1, lambda w, q: F.coalesce(w, F.lit(0.0)) + en * q)
        else:  # the sum of a user's y is still what phase 1 put into its v2
            ys = F.zip_with("v2", v1, lambda z, p: (z - p) / F.col("n"))
            m2 = (F.when(F.col("to_items").isNotNull(), F.zip_with("w1", ys, lambda w, y: F.col("n") * w - g7 * y))
                  .when(en.isNotNull(), F.transform(v1, lambda q: en * q)))
        before = v
        v = cut(v.join(grad, "id", "left").select(
            "id", F.coalesce(F.zip_with(v1, "w1", lambda o, g: o + g2 * (g - g7 * c * o)), F.col("v1")).alias("v1"),
            F.coalesce(F.zip_with(v2, m2, lambda o, g: o + g2 * (g - g7 * ci * o)), F.col("v2")).alias("v2"),
            (F.col("b") + F.coalesce(g1 * (F.col("es") - g6 * c * F.col("b")), F.lit(0.0))).alias("b"),
            "n", "to_items", "to_users"))
        for old in (before, *parts):
            release(old)
    # final pass: squared training error summed on each item
    se = None
    for low in range(0, gi, some):
        part = cut(column(v, low, "error", [F.col("v1")], False).groupBy("id").agg(F.sum("se").alias("se")))
        se = part if se is None else se.unionByName(part)
    return v.join(se, "id", "left").select("id", v1.alias("v1"), v2.alias("v2"), "b", F.coalesce("se", "n").alias("n")), u


def training_error(vertices: DataFrame, edges: DataFrame, items: Column) -> DataFrame:
    """The reference's report: the items' summed squared errors divided by
    the number of rating edges (the training mean squared error)."""
    n = edges.agg(F.count(F.lit(1))).scalar()
    return vertices.filter(items).agg(F.try_divide(F.sum("n"), n).alias("mse"))
