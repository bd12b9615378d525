"""Source divergence audit (operator 13): which terms and which other sources
set a source of a language apart.

Terms are runs of letters (ASCII letters lower-cased, and all other non-ASCII
characters).  A language keeps the V terms that occur in at least ``least`` of
its documents.  A group (lang, source) gives each kept term the share
p = 1 + floor(10**9 * (count + 1) / (N + V)), N its count of kept terms; the
language itself gives q in the same way; f(p, q) = floor((p - q)**2 / q).

Counting.  Tasks send one row per (language, term) and slice with a stripe of
counts per source.  Merged rows of kept terms are written once; all that
follows reads them.

Terms of a group, ranked by f(p, q) with p > q.  For one group p grows with the
group's count and q with the language's, so a term is outranked by every other
with at least its group count, at most its language count and an earlier place
in UTF-8 order: that one dominates it.  Tasks keep the k-skyband of every group
(the terms dominated by fewer than k others), skybands are merged by sub-groups
and then by group, and what is left is ranked exactly.

Pairs of sources.  The sum of f over all kept terms is taken from the terms
that occur in either source: with p0 the share of an absent term,

    sum f(p_g, p_h) = sum over g's terms of f(p_g, p0_h)
                    + sum over h's terms of f(p0_g, p_h)
                    + (V - |g| - |h|) f(p0_g, p0_h)
                    + sum over common terms of f(p_g, p_h) - f(p_g, p0_h) - f(p0_g, p_h) + f(p0_g, p0_h).

All arithmetic is in whole numbers: the division by N + V runs in three steps
of 1000, squares of differences of shares stay below 2**60, sums are added as
38-digit decimals.  The list of groups is broadcast: the result has a row per
ordered pair of a language's groups, so it is at most the root of the result.

Edge cases: null text, lang or source are ''; groups without terms, and
languages without kept terms, have pair rows (value 0 if V = 0) and no term
rows; repeated rows and null ids count as documents; ties go to the item
earlier in UTF-8; very long texts are one slice; an empty table gives no rows;
other input columns are ignored.  Two words (or sources) with one 64-bit hash
are an error, not a wrong count.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.iterate import cut_to_table
from . import stripes as S
from . import textops as T

LEAST = 3  # documents of a language that a kept term occurs in
TOP = 200  # terms returned for each group
SCALE = 1000  # shares are in units of 10**-9, taken in three steps

_SLICE = 6 << 20
_MERGE = 8 << 20
_PAIRS = 1 << 20  # pairs of sources of a term expanded at once
_BLOCK = 512

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / total), exact while total < 2**53."""
    part = count.astype(np.int64) + 1
    out = part // total
    rest = part - out * total
    for _ in range(3):
        rest = rest * SCALE
        digit = rest // total
        rest -= digit * total
        out = out * SCALE + digit
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def source_hash(col: pa.Array) -> np.ndarray:
    data, at = T.byte_view(col)
    return T.mix(T.run_hashes(data, at[:-1], at[1:]) ^ np.uint64(0x5851F42D4C957F2D))


def _count_slice(b: pa.RecordBatch) -> pa.RecordBatch:
    """(h, lang, term, d, sources, counts) of a slice: a row per (language,
    term), d its documents, the other two its count per source."""
    data, offsets = T.byte_view(b.column("text"))
    start, end = T.spans(_LETTER[data], offsets)
    doc = np.searchsorted(offsets, start, side="right") - 1
    terms = S.gather(T.lower_ascii(data), start, end).dictionary_encode()
    code = terms.indices.to_numpy().astype(np.int64)
    lang, source = (b.column(c).dictionary_encode() for c in ("lang", "source"))
    v, n, m = max(1, len(terms.dictionary)), b.num_rows, max(1, len(source.dictionary))
    lt = lang.indices.to_numpy().astype(np.int64)[doc] * v + code
    by_doc = np.unique(lt * n + doc) // n
    at = S.starts(by_doc)
    key, docs = by_doc[at], np.diff(np.append(at, len(by_doc)))
    entry, count = np.unique(lt * m + source.indices.to_numpy().astype(np.int64)[doc], return_counts=True)
    ends = np.searchsorted(entry // m, key, side="right")
    names, langs = terms.dictionary, lang.dictionary
    word = T.byte_view(names)
    word = T.run_hashes(word[0], word[1][:-1], word[1][1:])
    seed = T.byte_view(langs)
    seed = T.mix(T.run_hashes(seed[0], seed[1][:-1], seed[1][1:]))
    h = T.mix(word[key % v] ^ seed[key // v]) if len(key) else np.zeros(0, np.uint64)
    src = source_hash(source.dictionary)[entry % m] if len(entry) else np.zeros(0, np.uint64)
    return T.batch(["h", "lang", "term", "d", "sources", "counts"], [
        h.view(np.int64), langs.take(pa.array(key // v)), names.take(pa.array(key % v)), docs.astype(np.int64),
        S.as_binary(src, ends), S.as_binary(count.astype(np.int64), ends)])


def _merge_rows(t: pa.Table) -> pa.Table:
    """One row per h: documents summed, stripes merged elementwise."""
    h = t.column("h").to_numpy()
    at = S.starts(h)
    group = np.zeros(len(h), np.int64)
    group[at[1:]] = 1
    group = np.cumsum(group)
    for c in ("lang", "term"):
        own = t.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
        if (own != own[at][group]).any():
            raise ValueError("two terms have the same 64-bit hash")
    src, size = S.entries(t.column("sources"), np.uint64)
    n = S.entries(t.column("counts"), np.int64)[0]
    g = np.repeat(group, size)
    o = np.lexsort((src, g))
    g, src, n = g[o], src[o], n[o]
    first = S.starts(g, src)
    g, src, n = g[first], src[first], np.add.reduceat(n, first)
    ends = np.searchsorted(g, np.arange(len(at)), side="right")
    d = np.add.reduceat(t.column("d").to_numpy(), at)
    take = pa.array(at)
    return pa.table({"h": h[at], "lang": t.column("lang").take(take), "term": t.column("term").take(take), "d": d,
                     "sources": S.as_binary(src, ends), "counts": S.as_binary(n, ends)})


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, total (its count in the language), sources and counts (its
    stripe) of the terms in at least ``least`` documents of their language;
    ``docs`` has text, lang, source without nulls."""
    def emit(batches):
        for b in T.pieces(batches, "text", _SLICE):
            yield _count_slice(b)

    def merge(batches):
        for t in S.by_key(batches, ["h"], "sources", _MERGE, _merge_rows):
            m = _merge_rows(t)
            m = m.filter(pc.greater_equal(m.column("d"), least))
            n, size = S.entries(m.column("counts"), np.int64)
            total = np.add.reduceat(n, np.cumsum(size) - size) if len(size) else np.zeros(0, np.int64)
            for x in m.append_column("total", pa.array(total)).select(["lang", "term", "total", "sources", "counts"]).to_batches():
                yield x

    rows = docs.mapInArrow(emit, "h long, lang string, term string, d long, sources binary, counts binary")
    return (rows.repartition("h").sortWithinPartitions("h")
            .mapInArrow(merge, "lang string, term string, total long, sources binary, counts binary"))


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, s (its hash), n (occurrences of kept terms), v (the
    language's kept terms) of every occurring group."""
    def hashes(batches):
        for b in batches:
            yield T.batch(["lang", "source", "s"], [b.column("lang"), b.column("source"), source_hash(b.column("source")).view(np.int64)])

    def sums(batches):
        for b in batches:
            src, size = S.entries(b.column("sources"), np.uint64)
            n = S.entries(b.column("counts"), np.int64)[0]
            lang = b.column("lang").dictionary_encode()
            own = np.repeat(lang.indices.to_numpy(), size)
            o = np.lexsort((src, own))
            first = S.starts(own[o], src[o])
            if len(first):
                at = o[first]
                yield T.batch(["lang", "s", "n"], [lang.dictionary.take(pa.array(own[at])), src[at].view(np.int64), np.add.reduceat(n[o], first)])

    groups = docs.select("lang", "source").distinct().mapInArrow(hashes, "lang string, source string, s long")
    n = kept.select("lang", "sources", "counts").mapInArrow(sums, "lang string, s long, n long").groupBy("lang", "s").agg(F.sum("n").alias("n"))
    v = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    return (groups.join(n, ["lang", "s"], "left").join(v, "lang", "left")
            .select("lang", "source", "s", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")))


class Groups:
    """The groups in order of (lang, hash): arrays over all groups, and for
    each language its range."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (r.lang, r.s % (1 << 64)))
        for a, b in zip(rows, rows[1:]):
            if (a.lang, a.s) == (b.lang, b.s):
                raise ValueError("two sources have the same 64-bit hash")
        self.lang, self.source = [r.lang for r in rows], [r.source for r in rows]
        self.s = np.array([r.s % (1 << 64) for r in rows], np.uint64)
        self.n, self.v = (np.array([getattr(r, c) for r in rows], np.int64) for c in ("n", "v"))
        self.total = np.maximum(self.n + self.v, 1)
        self.zero = shares(np.zeros(len(rows), np.int64), self.total)
        self.range, self.all = {}, {}
        for i, x in enumerate(self.lang):
            self.range[x] = (self.range.get(x, (i, i))[0], i + 1)
        for x, (a, b) in self.range.items():
            self.all[x] = int(self.n[a:b].sum()) + int(self.v[a])

    def parts(self, t: pa.RecordBatch):
        """For each language of a batch: (lang, its rows, row of each entry,
        group of each entry, count of each entry)."""
        langs = t.column("lang").dictionary_encode()
        own = langs.indices.to_numpy()
        for i, x in enumerate(langs.dictionary.to_pylist()):
            rows = t.filter(pa.array(own == i))
            src, size = S.entries(rows.column("sources"), np.uint64)
            a, b = self.range[x]
            yield x, rows, np.repeat(np.arange(rows.num_rows), size), a + np.searchsorted(self.s[a:b], src), S.entries(rows.column("counts"), np.int64)[0]


def skyband(c: np.ndarray, total: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Positions of the terms that fewer than ``k`` others dominate: group
    count at least ``c``, language count at most ``total``, earlier ``place``.
    A dropped term has k dominators that are kept (dominance is transitive), so
    it is enough to count among those."""
    order = np.lexsort((place, total, c * -1))
    kept = np.zeros(0, np.int64)
    for low in range(0, len(order), _BLOCK):
        new = order[low:low + _BLOCK]
        before = ((total[kept][None, :] <= total[new][:, None]) & (place[kept][None, :] < place[new][:, None])).sum(axis=1)
        within = (total[new][None, :] <= total[new][:, None]) & (place[new][None, :] < place[new][:, None])
        before += np.tril(within, -1).sum(axis=1)
        kept = np.concatenate([kept, new[before < k]])
    return kept


_BAND = "lang string, source string, term string, c long, total long, f long"


class Bands:
    """Skybands of several groups, kept up as batches come."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, key, term: pa.Array, c: np.ndarray, total: np.ndarray, f: np.ndarray) -> None:
        old = self.held.get(key)
        if old is not None:
            term = pa.concat_arrays([old[0], term])
            c, total, f = (np.concatenate([o, x]) for o, x in zip(old[1:], (c, total, f)))
        at = skyband(c, total, pc.rank(term, tiebreaker="first").to_numpy().astype(np.int64), self.k)
        self.held[key] = (term.take(pa.array(at)), c[at], total[at], f[at])

    def batches(self):
        for (lang, source), (term, c, total, f) in self.held.items():
            yield T.batch(["lang", "source", "term", "c", "total", "f"],
                          [pa.array([lang] * len(c), pa.string()), pa.array([source] * len(c), pa.string()), term, c, total, f])


def term_bands(kept: DataFrame, groups: Groups, k: int) -> DataFrame:
    """The merged k-skybands of all groups."""
    shared = kept.sparkSession.sparkContext.broadcast(groups)

    def local(batches):
        g, bands = shared.value, Bands(k)
        for b in batches:
            for lang, rows, row, group, c in g.parts(b):
                total = rows.column("total").to_numpy()
                p = shares(c, g.total[group])
                q = shares(total, np.int64(g.all[lang]))[row]
                at = np.flatnonzero(p > q)
                at = at[np.argsort(group[at], kind="stable")]
                cut = S.starts(group[at])
                for x in np.split(at, cut[1:]) if len(at) else ():
                    bands.add((lang, g.source[group[x[0]]]), rows.column("term").take(pa.array(row[x])), c[x], total[row[x]], distance(p[x], q[x]))
        yield from bands.batches()

    def merge(batches):
        key, bands = None, Bands(k)
        for b in batches:
            names = [b.column(x).dictionary_encode() for x in ("lang", "source")]
            a, s = (x.indices.to_numpy() for x in names)
            at = S.starts(a, s)
            for low, high in zip(at, np.append(at[1:], b.num_rows)):
                own = tuple(x.dictionary[int(x.indices[int(low)].as_py())].as_py() for x in names)
                if own != key:  # rows are sorted by group: the last one is done
                    yield from bands.batches()
                    key, bands = own, Bands(k)
                part = b.slice(int(low), int(high - low))
                bands.add(own, part.column("term"), *(part.column(x).to_numpy() for x in ("c", "total", "f")))
        yield from bands.batches()

    rows = kept.mapInArrow(local, _BAND)
    # a group's skybands meet by parts first, as many as the root of the tasks
    parts = math.isqrt(int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    part = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")
    rows = rows.withColumn("part", part).repartition("lang", "source", "part").sortWithinPartitions("lang", "source").drop("part").mapInArrow(merge, _BAND)
    return rows.repartition("lang", "source").sortWithinPartitions("lang", "source").mapInArrow(merge, _BAND)


def _pair_sums(g: Groups, lang: str, row: np.ndarray, group: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What the terms of a batch add to each ordered pair of a language's groups."""
    a, b = g.range[lang]
    m, zero, own = b - a, g.zero[a:b], group - a
    p = shares(c, g.total[group])
    out = np.zeros((m, m), np.int64)
    # by (group, share): against the absent share of every other group
    key, count = np.unique(np.stack([own, p]), axis=1, return_counts=True)
    step = max(1, _PAIRS // m)
    for low in range(0, key.shape[1], step):
        who, x, n = key[0, low:low + step], key[1, low:low + step, None], count[low:low + step, None]
        np.add.at(out, who, distance(x, zero[None, :]) * n)
        np.add.at(out.T, who, distance(zero[None, :], x) * n)
    # common terms: all ordered pairs of a term's entries, in runs
    order = np.argsort(row, kind="stable")
    row, own, p = row[order], own[order], p[order]
    first = S.starts(row)
    size = np.diff(np.append(first, len(row)))
    each, begin = np.repeat(size, size), np.repeat(first, size)
    done = np.cumsum(each)
    low = 0
    while low < len(row):
        base = done[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(done, base + _PAIRS, side="right")))
        k = each[low:high]
        x = np.repeat(np.arange(low, high), k)
        y = np.repeat(begin[low:high] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        px, py, zx, zy = p[x], p[y], zero[own[x]], zero[own[y]]
        np.add.at(out, (own[x], own[y]), distance(px, py) - distance(px, zy) - distance(zx, py) + distance(zx, zy))
        low = high
    return out


def pair_sums(kept: DataFrame, groups: Groups) -> DataFrame:
    """lang, source, item, sum: the parts of the pairs' sums that come from
    terms occurring in either source."""
    shared = kept.sparkSession.sparkContext.broadcast(groups)

    def task(batches):
        g, sums = shared.value, {}
        for b in batches:
            for lang, rows, row, group, c in g.parts(b):
                sums[lang] = sums.get(lang, 0) + _pair_sums(g, lang, row, group, c)
        for lang, out in sums.items():
            a, b = g.range[lang]
            m = b - a
            for i in range(m):
                yield T.batch(["lang", "source", "item", "part"], [pa.array([lang] * m), pa.array([g.source[a + i]] * m), pa.array(g.source[a:b]), out[i]])

    rows = kept.mapInArrow(task, "lang string, source string, item string, part long")
    return rows.groupBy("lang", "source", "item").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("sum"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    src = docs.select(text(text_col).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source"))
    kept = cut_to_table(kept_terms(src, least))
    table = cut_to_table(group_totals(src, kept))
    groups = Groups(table.collect())  # at most the root of the result

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (term_bands(kept, groups, top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("f").alias("value"))
             .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))

    present = kept.select("lang", F.col("sources")).mapInArrow(_present, "lang string, s long, k long").groupBy("lang", "s").agg(F.sum("k").alias("k"))
    sides = cut_to_table(table.join(present, ["lang", "s"], "left").select("lang", "source", "n", "v", F.coalesce("k", F.lit(0)).alias("k")))
    other = sides.select("lang", F.col("source").alias("item"), F.col("n").alias("n2"), F.col("k").alias("k2"))
    zero = lambda n: F.lit(1) + F.expr(f"1000000000 div ({n} + v)")
    both = F.col("v") - F.col("k") - F.col("k2")
    pairs = (sides.join(other, "lang").filter("source <> item")
             .join(pair_sums(kept, groups), ["lang", "source", "item"], "left")
             .withColumn("z", F.when(F.col("v") > 0, zero("n"))).withColumn("z2", F.when(F.col("v") > 0, zero("n2")))
             .withColumn("absent", F.expr("((z - z2) * (z - z2)) div z2"))
             .withColumn("value", F.when(F.col("v") == 0, F.lit(0)).otherwise(
                 (F.coalesce("sum", F.lit(0).cast("decimal(38,0)")) + both.cast("decimal(19,0)") * F.col("absent").cast("decimal(19,0)")).cast("long")))
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
             .withColumn("rank", F.row_number().over(order)))
    return pairs.unionByName(terms)


def _present(batches):
    """(lang, s, k): kept terms that occur in each group, by batch."""
    for b in batches:
        lang = b.column("lang").dictionary_encode()
        src, size = S.entries(b.column("sources"), np.uint64)
        own = np.repeat(lang.indices.to_numpy(), size)
        o = np.lexsort((src, own))
        at = S.starts(own[o], src[o])
        if len(at):
            yield T.batch(["lang", "s", "k"], [lang.dictionary.take(pa.array(own[o][at])), src[o][at].view(np.int64), np.diff(np.append(at, len(o)))])
