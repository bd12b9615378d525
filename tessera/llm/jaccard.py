"""N-gram Jaccard join by parity sketches (operator 1).

A document's set holds its distinct k-word shingles (4 by default).  Two
documents link when |intersection| >= s * |union| (s is 0.85 by default), which
for sizes a and b is the same as

    |symmetric difference| <= (1 - s) * (a + b) / (1 + s).

Size bands.  Linked sets' sizes differ by a factor of 1 / s at most, so with
bands of that ratio a set meets partners in its own band, the one below and the
one above.  A join level belongs to the smaller partner's band; each set takes
part in its own band's level and in the one below.

Parity sketches.  At a level whose pairs differ in at most d shingles, every
shingle falls in one of m > d parts by its hash, and a part's key is the XOR of
its shingles' 64-bit hashes.  A differing shingle changes one part, so the
number of differing parts bounds the symmetric difference from below, and by
the pigeonhole principle linked sets agree in at least m - d parts.  A part
without shingles says nothing, so its key is emitted only by sets with m - d or
more such parts (then all agreeing parts could be empty ones).  A longer bit
sketch, in which each shingle flips one bit, gives a sharper bound for
candidates before texts are compared.

Candidates.  Equal sets are one class, joined by a fingerprint.  Within a
bucket of equal keys a member is compared with the bucket's centre only (a
different random member for each key), not with all others; verified links form
components.  Buckets that still hold several components are then searched for
pairs of different components whose bit sketches permit a link.  A bucket's
members are dealt into blocks of about ``BLOCK``, its largest component's apart
from the others', and every pair of blocks that may hold such a pair is a group
of its own, so a task holds two blocks however large the bucket is.  Every pair
that may link is either verified or already connected, and nothing is capped.

Verification compares the shingle sets of the two texts.

Edge cases: a null text, or one without words, has an empty set, links with
nothing and is its own component; a text of fewer than k words has its word
sequence as its one shingle; repeated ids count as one vertex: their texts are linked
each on its own, and the result has a row per input row; null ids get a null
component and link nothing; an empty table gives no rows; other input columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.iterate import cut_to_table
from . import textops as T

SHINGLE = 4
PERCENT = 85
BLOCK = 2048

_SEED = np.uint64(0xD1B54A32D192ED03)


class Law:
    """Which sets link, and what follows for size bands and sketches."""

    def __init__(self, percent: int = PERCENT):
        if not 50 <= percent <= 100:
            raise ValueError("a similarity of 50 to 100 per cent")
        self.percent = percent
        bands, s = [], 1
        while s < 1 << 40:
            bands.append(s)
            s = max(s + 1, -(-s * 100 // percent))
            if percent > 99 and s > 1 << 20:
                break
        self.bands = np.array(bands, dtype=np.int64)

    def links(self, na, nb, both):
        return (both > 0) & (100 * both >= self.percent * (na + nb - both))

    def may_link(self, na, nb, distance):
        """Whether sets of these sizes may differ in as little as ``distance``."""
        return (100 + self.percent) * distance <= (100 - self.percent) * (na + nb)

    def band_of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bands, n, side="right") - 1

    def most_difference(self, level: np.ndarray) -> np.ndarray:
        """Largest symmetric difference of a linked pair whose smaller set has a
        shingles and lies in band ``level``: (1 - s) (a + a / s) / (1 + s) for
        similarity s, that is (1 - s) a / s."""
        return (100 - self.percent) * (self.bands[level + 1] - 1) // self.percent

    def parts_of(self, level: np.ndarray) -> np.ndarray:
        d = self.most_difference(level)
        return d + 1 + np.maximum(d > 0, d // 16)

    def sketch_bits(self, level: np.ndarray) -> np.ndarray:
        """Bits of the sketch at a level: a power of two, at least twice the size."""
        return 1 << np.ceil(np.log2(np.maximum(2 * self.bands[level + 1], 64))).astype(np.int64)


def level_keys(law: Law, first: np.ndarray, h: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) at the level ``shift`` bands below each set's own."""
    n = np.diff(first)
    sets = np.flatnonzero(n > 0)
    sets = sets[law.band_of(n[sets]) >= shift]
    if not len(sets):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    level = law.band_of(n[sets]) - shift
    m, d = law.parts_of(level), law.most_difference(level)
    owner = np.repeat(np.arange(len(sets)), n[sets])
    take = np.concatenate([[0], np.cumsum(n[sets])])
    x = h[np.repeat(first[sets] - take[:-1], n[sets]) + np.arange(take[-1])]
    # part = high half of the hash scaled to [0, m)
    part = ((T.mix(x ^ _SEED) >> np.uint64(32)) * m[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(m)])
    slot = base[owner] + part
    order = np.argsort(slot, kind="stable")
    slot, x = slot[order], x[order]
    begin = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    value = np.bitwise_xor.reduceat(x, begin)
    used = slot[begin]
    full = np.zeros(base[-1], bool)
    full[used] = True
    own = np.repeat(np.arange(len(sets)), m)
    empties = np.bincount(own[~full], minlength=len(sets))
    keys = np.zeros(base[-1], np.uint64)
    keys[used] = value
    emit = full | (empties >= m - d)[own]
    at = np.flatnonzero(emit)
    own = own[at]
    where = T.mix(level[own].astype(np.uint64) << np.uint64(40) ^ (at - base[own]).astype(np.uint64))
    tag = np.where(full[at], np.uint64(0), np.uint64(1))
    return sets[own], T.mix(keys[at] * np.uint64(2) + tag ^ where)


def bit_sketch(h: np.ndarray, bits: int) -> np.ndarray:
    """The parity sketch of a set, as bytes: bit b is the parity of the number
    of shingles that fall on b.  Folding its halves with XOR gives the sketch
    of half as many bits."""
    count = np.bincount((T.mix(h ^ _SEED ^ np.uint64(1)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little")


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch folded to ``size`` bytes."""
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _fingerprints(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set (0 for empty sets); with the size it
    names a class of equal sets."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        total = np.add.reduceat(T.mix(h), first[:-1][some])
        out[some] = T.mix(total ^ T.mix(n[some].astype(np.uint64)))
    return out


def set_table(docs: DataFrame, law: Law, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (set size), g (set fingerprint), sketch."""
    def task(batches):
        for b in T.pieces(batches, "text"):
            first, h = T.Words(b.column("text"), lower=True).shingles(shingle)
            n = np.diff(first)
            bits = law.sketch_bits(law.band_of(np.maximum(n, 1)))
            sk = [bit_sketch(h[first[i]:first[i + 1]], int(bits[i])).tobytes() if n[i] else None for i in range(len(n))]
            yield T.batch(["doc_id", "n", "g", "sketch"], [b.column("doc_id"), n.astype(np.int64), _fingerprints(first, h).view(np.int64), pa.array(sk, pa.binary())])

    return _source(docs, id_col, text_col).mapInArrow(task, "doc_id long, n long, g long, sketch binary")


def shared_keys(docs: DataFrame, law: Law, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, g, centre) of all keys that at least two different sets share; the
    centre is one of the key's sets, a random one for each key.

    A task sends a class of equal sets once, however many copies it reads, so
    a group of copies adds a row a task to a key.  Rows of one key are then
    sorted together and streamed: keys of one class are dropped as they pass,
    without holding a key's rows at once."""
    def emit(batches):
        seen: set[int] = set()
        for b in T.pieces(batches, "text"):
            first, h = T.Words(b.column("text"), lower=True).shingles(shingle)
            g = _fingerprints(first, h).view(np.int64)
            new = np.zeros(len(g), bool)
            new[np.unique(g, return_index=True)[1]] = True
            new &= np.array([int(x) not in seen for x in g], bool) & (np.diff(first) > 0)
            seen.update(g[new].tolist())
            for shift in (0, 1):
                who, key = level_keys(law, first, h, shift)
                ok = new[who]
                yield T.batch(["key", "g"], [key[ok].view(np.int64), g[who[ok]]])

    def keep(batches):
        hk = hg = hc = None  # the last row so far and its key's centre
        sent = True  # whether it has been sent, as one of several of its key
        for b in batches:
            k, g = b.column("key").to_numpy(zero_copy_only=False), b.column("g").to_numpy(zero_copy_only=False)
            if not len(k):
                continue
            held = hk is not None
            if held:
                k, g = np.concatenate([[hk], k]), np.concatenate([[hg], g])
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
            k, g = k[new], g[new]
            begin = np.ones(len(k), bool)
            begin[1:] = k[1:] != k[:-1]
            c = g[np.flatnonzero(begin)][np.cumsum(begin) - 1]
            if held:
                c[k == hk] = hc
            several = np.zeros(len(k), bool)
            several[1:] |= ~begin[1:]
            several[:-1] |= ~begin[1:]
            out = several.copy()
            if held and sent:
                out[0] = False
            # the last row may meet a partner in the next batch
            sent = bool(several[-1]) or (held and sent and len(k) == 1)
            hk, hg, hc = k[-1], g[-1], c[-1]
            yield T.batch(["key", "g", "centre"], [k[out], g[out], c[out]])

    rows = _source(docs, id_col, text_col).mapInArrow(emit, "key long, g long")
    return (rows.repartition("key").withColumn("_order", F.xxhash64("key", "g")).sortWithinPartitions("key", "_order", "g")
            .select("key", "g").mapInArrow(keep, "key long, g long, centre long"))


def star_pairs(keys: DataFrame) -> DataFrame:
    """(a, b): each member of a key with the key's centre, once a pair."""
    return (keys.filter("g <> centre")
            .select(F.least("g", "centre").alias("a"), F.greatest("g", "centre").alias("b")).distinct())


def sketch_filter(pairs: DataFrame, sets: DataFrame, law: Law) -> DataFrame:
    """The pairs (a, b) whose bit sketches permit a link."""
    def task(batches):
        for b in batches:
            ok = []
            for na, sa, nb, sb in zip(*(b.column(c).to_pylist() for c in ("na", "sa", "nb", "sb"))):
                x, y = np.frombuffer(sa, np.uint8), np.frombuffer(sb, np.uint8)
                size = min(len(x), len(y))
                distance = int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())
                ok.append(bool(law.may_link(na, nb, distance)))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda x: sets.select(F.col("g").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "na", "sa", "b", "nb", "sb").mapInArrow(task, "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, docs: DataFrame, law: Law, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pairs (a, b) of set fingerprints whose sets link, by comparing the
    texts of one document of either class."""
    def task(batches):
        for batch in batches:
            for b in T.pieces([batch], "ta"):
                fa, ha = T.Words(b.column("ta"), lower=True).shingles(shingle)
                fb, hb = T.Words(b.column("tb"), lower=True).shingles(shingle)
                row = lambda f: np.repeat(np.arange(len(f) - 1), np.diff(f))
                na, nb = np.diff(fa), np.diff(fb)
                # a hash of (pair, shingle) occurs twice when both sets hold it
                every = np.concatenate([T.mix(ha ^ T.mix(row(fa).astype(np.uint64))), T.mix(hb ^ T.mix(row(fb).astype(np.uint64)))])
                who = np.concatenate([row(fa), row(fb)])
                order = np.lexsort((every, who))
                e, w = every[order], who[order]
                twice = w[1:][(e[1:] == e[:-1]) & (w[1:] == w[:-1])]
                both = np.bincount(twice, minlength=len(na))
                yield b.select(["a", "b"]).filter(pa.array(law.links(na, nb, both)))

    reps = sets.select("g", "doc_id")
    text = _source(docs, id_col, text_col).withColumnRenamed("text", "t")
    # a repeated id may stand for several texts; the one with the set counts
    need = pairs.select(F.col("a").alias("g")).union(pairs.select(F.col("b").alias("g"))).distinct().join(reps, "g")
    texts = cut_to_table(text.join(need, "doc_id").select("g", "t").mapInArrow(_of_set(shingle), "g long, t string").dropDuplicates(["g"]))
    side = lambda x: texts.select(F.col("g").alias(x), F.col("t").alias(f"t{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(task, "a long, b long")


def _of_set(shingle: int):
    """Keeps the rows (g, t) whose text has the set g."""
    def task(batches):
        for b in T.pieces(batches, "t"):
            g = _fingerprints(*T.Words(b.column("t"), lower=True).shingles(shingle)).view(np.int64)
            yield b.filter(pa.array(g == b.column("g").to_numpy(zero_copy_only=False)))
    return task


def deal_blocks(labelled: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, j, side, g, c): the members of every key that holds several
    components, dealt into pairs of blocks ``j``.

    The members of a key's largest component are dealt into blocks of about
    ``block`` by hash, and so are the others.  The largest component needs no
    search in itself, so the pairs are: each of its blocks (side 0) with each
    block of others (side 1), each two blocks of others (sides 0 and 1), and
    each block of others with itself (side 2)."""
    count = labelled.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k"))
    # (of two sets one is the centre, so that pair has been verified)
    most = cut_to_table(count.groupBy("key").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("size"), F.count(F.lit(1)).alias("cs"))
                        .filter("cs > 1 and size > 2")
                        .select("key", F.col("top.c").alias("top"), F.ceil(F.col("top.k") / block).cast("long").alias("tops"),
                                F.ceil((F.col("size") - F.col("top.k")) / block).cast("long").alias("rest")))
    code = lambda x, y: x * F.lit(1 << 31) + y
    pair = lambda j, side: F.struct(j.alias("j"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    home = F.col("home")
    of_top = F.transform(upto("rest"), lambda y: pair(code(home, y), 0))
    of_rest = F.concat(F.transform(upto("tops"), lambda x: pair(code(x, home), 1)),
                       F.transform(upto("rest"), lambda x: pair(-F.lit(1) - code(F.least(x, home), F.greatest(x, home)),
                                                                F.when(x == home, 2).when(home < x, 0).otherwise(1))))
    is_top = F.col("c") == F.col("top")
    return (labelled.join(most, "key")
            .withColumn("home", F.pmod(F.xxhash64("g"), F.when(is_top, F.col("tops")).otherwise(F.col("rest"))))
            .withColumn("to", F.explode(F.when(is_top, of_top).otherwise(of_rest)))
            .select("key", "to.j", "to.side", "g", "c"))


def cross_pairs(keys: DataFrame, sets: DataFrame, comp: DataFrame, law: Law, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs of one key but of different components whose bit sketches
    permit a link, searched in pairs of blocks (``deal_blocks``)."""
    def search(batches):
        """Streams pairs of blocks sorted by (key, j) and searches each."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            k, j = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "j"))
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                part = b.slice(s, e - s)
                if held and (held[-1].column("key")[0] != part.column("key")[0] or held[-1].column("j")[0] != part.column("j")[0]):
                    yield from _search_blocks(held, law)
                    held = []
                held.append(part)
        if held:
            yield from _search_blocks(held, law)

    dealt = deal_blocks(cut_to_table(keys.join(comp, "g")), block).join(sets.select("g", "n", "sketch"), "g").select("key", "j", "side", "g", "c", "n", "sketch")
    return (dealt.repartition("key", "j").sortWithinPartitions("key", "j").mapInArrow(search, "a long, b long").distinct())


def _search_blocks(held: list[pa.RecordBatch], law: Law):
    t = pa.Table.from_batches(held)
    g, c, n, side = (t.column(x).to_numpy() for x in ("g", "c", "n", "side"))
    if side[0] != 2 and (side == side[0]).all():
        return  # the other block of the pair is empty
    raw = [np.frombuffer(x, np.uint8) for x in t.column("sketch").to_pylist()]
    size = min(map(len, raw))
    sk = np.array([fold(x, size) for x in raw]).view(np.uint64)
    if side[0] == 2:
        # members of the block's most frequent component need no search among themselves
        labels, number = np.unique(c, return_inverse=True)
        mine, other = np.flatnonzero(number != np.bincount(number).argmax()), np.arange(len(g))
    else:
        mine, other = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        if len(mine) > len(other):
            mine, other = other, mine
    sk, against, co, no, go = sk[mine], sk[other], c[other], n[other], g[other]
    out_a, out_b = [], []
    for i, x in enumerate(mine):
        distance = np.bitwise_count(against ^ sk[i]).sum(axis=1, dtype=np.int64)
        hit = np.flatnonzero((co != c[x]) & law.may_link(no, n[x], distance))
        out_a.append(np.minimum(go[hit], g[x]))
        out_b.append(np.maximum(go[hit], g[x]))
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
    if len(a):
        pair = np.unique(np.stack([a, b], axis=1), axis=0)
        yield T.batch(["a", "b"], [np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1])])


def components(sets: DataFrame, links: DataFrame) -> DataFrame:
    """(g, c): the component of each set that has a link."""
    cc = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return cc.select(F.col("id").alias("g"), F.col("component").alias("c"))


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), and
    n_copies, the number of documents with an equal set."""
    law = Law(percent)
    members = cut_to_table(set_table(docs, law, shingle, id_col, text_col))
    sets = cut_to_table(members.filter("n > 0").groupBy("g").agg(
        F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("n_copies")))
    keys = cut_to_table(shared_keys(docs, law, shingle, id_col, text_col))
    near = cut_to_table(sketch_filter(star_pairs(keys), sets, law))
    links = cut_to_table(verify(near, sets, docs, law, shingle, id_col, text_col))
    first = components(sets, links)
    comp = cut_to_table(sets.select("g").join(first, "g", "left").select("g", F.coalesce("c", "g").alias("c")))
    more = cut_to_table(cross_pairs(keys, sets, comp, law).join(near, ["a", "b"], "left_anti"))
    late = cut_to_table(verify(more, sets, docs, law, shingle, id_col, text_col))
    # the links between components join those components
    lab = lambda x: comp.select(F.col("g").alias(x), F.col("c").alias(f"c{x}"))
    across = late.join(lab("a"), "a").join(lab("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a <> b").distinct()
    top = components(sets, cut_to_table(across)).select(F.col("g").alias("c"), F.col("c").alias("top"))
    final = comp.join(top, "c", "left").select("g", F.coalesce("top", "c").alias("c"))
    labelled = cut_to_table(sets.select("g", "doc_id", "n_copies").join(final, "g"))
    smallest = cut_to_table(labelled.groupBy("c").agg(F.min("doc_id").alias("component_id")))
    by_set = cut_to_table(labelled.join(smallest, "c").select("g", "component_id", "n_copies"))
    return (members.join(by_set, "g", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
                    F.coalesce("n_copies", F.lit(1)).alias("n_copies")))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are their component's smallest id, with all their
    columns; of rows with equal id and text one stays, rows without an id all
    stay."""
    keep = (jaccard_components(docs, shingle, percent, id_col, text_col).filter("component_id = doc_id")
            .select(F.col("doc_id").alias("_kept_id")).distinct())
    keep = cut_to_table(keep)
    named = docs.join(keep, F.col(id_col).cast("long") == F.col("_kept_id"), "left_semi")
    one = named.withColumn("_text_hash", F.xxhash64(text_col)).dropDuplicates([id_col, "_text_hash"]).drop("_text_hash")
    return one.unionByName(docs.filter(F.col(id_col).isNull()))
