"""Phrase collocation mining by stripes (operator 11).

Texts are cut into pieces at punctuation and line breaks, pieces into words.
Every word occurrence adds one to its prefix's stripe: an associative counter
of the next two words (``END`` where the piece ends).  Stripes are merged
elementwise, in each task and then by prefix, and one merged stripe has all
that the miner asks for:

* the entries are the counts of the three-word phrases that start with it,
* their sums by next word are the counts of its two-word phrases (the prefix's
  extensions),
* the sum of all entries is the prefix's own count, ends included,
* the largest entry under a next word says whether a two-word phrase is
  subsumed by a longer one to its right.

What is left needs candidates only (phrases of at least ``least``
occurrences): the counts of a phrase's rest, and the largest longer phrase to
the left, are joins between tables of candidates.

Everything is counted per language, whose hash is part of the words' hashes.  A
stripe's row carries its prefix as text, so the words' texts come along with the
counts; two words with one 64-bit hash are an error, not a wrong count.
Prefixes with many entries are split by the next word, so no stripe is merged
whole in one task, and sums of products use 38-digit decimals.

Edge cases: a null text has no words; a null language is ``und``; a language
without candidates has no rows; repeated rows (and null ids, which play no part)
count each; very long texts are cut into runs of tokens; ties go to the higher
count, then to the phrase earlier in UTF-8; an empty table gives no rows; other
input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.iterate import cut_to_table
from . import stripes as S
from . import textops as T

LEAST = 10  # occurrences of a candidate
SUBSUMED = 50  # per cent of a phrase's occurrences that lie in one longer phrase
TOP = 2000  # phrases returned for each language

_CHUNK = (1 << 20) - 4  # positions whose words fit 21-bit codes
_MERGE = 16 << 20  # bytes of entries merged at once
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_INSIDE = ~_BREAK
_INSIDE[[9, 32]] = False


class Run:
    """The words of a slice: text bytes, ``start``/``end``, ``hash`` (of
    language and word), ``lang`` code, and ``linked``: the next word lies in
    the same piece."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        data, offsets = T.byte_view(text)
        self.data = T.lower_ascii(data)
        self.start, self.end = T.spans(_INSIDE[data], offsets)
        doc = np.searchsorted(offsets, self.start, side="right") - 1
        codes = lang.dictionary_encode()
        self.langs = codes.dictionary
        own = codes.indices.to_numpy(zero_copy_only=False)
        names, at = T.byte_view(self.langs)
        seed = T.mix(T.run_hashes(names, at[:-1], at[1:]))
        self.lang = own[doc]
        self.hash = T.mix(T.run_hashes(self.data, self.start, self.end) ^ seed[self.lang]) if len(doc) else np.zeros(0, np.uint64)
        breaks = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_BREAK[data], out=breaks[1:])
        self.linked = np.zeros(len(doc), bool)
        self.linked[:-1] = (doc[1:] == doc[:-1]) & (breaks[self.start[1:]] == breaks[self.end[:-1]])


def _stripes(runs: list[Run], hot: dict[int, int]):
    """Combined stripes of some slices, as rows."""
    base = np.cumsum([0, *(len(r.data) for r in runs)])
    data = np.concatenate([r.data for r in runs])
    start, end = (np.concatenate([getattr(r, c) + b for r, b in zip(runs, base)]) for c in ("start", "end"))
    names = pa.concat_arrays([r.langs.cast(pa.string()) for r in runs])
    lang_at = np.cumsum([0, *(len(r.langs) for r in runs)])
    lang = np.concatenate([r.lang + b for r, b in zip(runs, lang_at)])
    h, linked = (np.concatenate([getattr(r, c) for r in runs]) for c in ("hash", "linked"))
    for low in range(0, len(h), _CHUNK):
        high = min(low + _CHUNK, len(h))
        vocab, first, code = np.unique(h[low:high + 2], return_index=True, return_inverse=True)
        code = code.astype(np.uint64) + np.uint64(1)  # 0 is END
        m = high - low
        one, two, three = code[:m], np.zeros(m, np.uint64), np.zeros(m, np.uint64)
        a = np.flatnonzero(linked[low:high])
        two[a] = code[a + 1]
        b = a[linked[low + a + 1]]
        three[b] = code[b + 2]
        key = np.sort((one << np.uint64(42)) | (two << np.uint64(21)) | three)
        at = S.starts(key)
        key, count = key[at], np.diff(np.append(at, m)).astype(np.uint32)
        mask = np.uint64((1 << 21) - 1)
        words = np.concatenate([[S.END], vocab])
        one = (key >> np.uint64(42)).astype(np.int64)
        p = words[one]
        nexts = np.stack([words[((key >> np.uint64(21)) & mask).astype(np.int64)], words[(key & mask).astype(np.int64)]], axis=1)
        shard = S.shard_of(p, nexts[:, 0], hot)
        if shard.any():
            o = np.lexsort((shard, one))
            one, p, nexts, shard, count = one[o], p[o], nexts[o], shard[o], count[o]
        at = S.starts(one, shard)
        ends = np.append(at[1:], len(one))
        where = first[one[at] - 1] + low
        yield T.batch(["h", "shard", "lang", "word", "nexts", "counts"], [
            p[at].view(np.int64), shard[at], names.take(pa.array(lang[where])), S.gather(data, start[where], end[where]),
            S.as_binary(nexts.ravel(), ends * 2), S.as_binary(count, ends)])


def merged(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """What the merged stripes say, a row each, by ``kind``: 1 a prefix (h1,
    lang, word, its count a, or a shard's part of it), 2 a phrase of two words
    (h1, h2, a, and m, the largest count of a longer phrase to its right), 3 of
    three (h1, h2, h3, a, and m, the count of its first two)."""
    spark = docs.sparkSession
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    share = S.least_share(spark)

    def count(batches):
        for b in T.pieces(batches, "text"):
            yield S.frequent(Run(b.column("text"), b.column("lang")).hash, share)

    hot = S.hot_words(src.mapInArrow(count, "h long, n long"), share)

    def emit(batches):
        held: list[Run] = []
        for b in T.pieces(batches, "text"):
            held.append(Run(b.column("text"), b.column("lang")))
            if sum(len(r.hash) for r in held) >= S.TOKENS * 7 // 8:
                yield from _stripes(held, hot)
                held = []
        if held:
            yield from _stripes(held, hot)

    def merge(batches):
        for t in S.by_key(batches, ["h", "shard"], "nexts", _MERGE):
            h, shard = (t.column(c).to_numpy() for c in ("h", "shard"))
            at = S.starts(h, shard)
            group = np.zeros(len(h), np.int64)
            group[at[1:]] = 1
            group = np.cumsum(group)
            for c in ("lang", "word"):
                own = t.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
                if (own != own[at][group]).any():
                    raise ValueError("two words have the same 64-bit hash")
            nexts, size = S.entries(t.column("nexts"), np.uint64)
            n = S.entries(t.column("counts"), np.uint32)[0].astype(np.int64)
            two, three = nexts[::2], nexts[1::2]
            g = np.repeat(group, size // 2)
            o = np.lexsort((three, two, g))
            g, two, three, n = g[o], two[o], three[o], n[o]
            f = S.starts(g, two, three)
            g, two, three, n = g[f], two[f], three[f], np.add.reduceat(n[f[0]:], f)
            pair = S.starts(g, two)
            length = np.diff(np.append(pair, len(g)))
            f2 = np.add.reduceat(n, pair)
            longer = np.where((three != S.END) & (n >= least), n, 0)
            m = np.maximum.reduceat(longer, pair)
            f1 = np.add.reduceat(f2, S.starts(g[pair]))
            two_at = np.flatnonzero((two[pair] != S.END) & (f2 >= least))
            three_at = np.flatnonzero(longer)
            first = h[at]
            k = [len(at), len(two_at), len(three_at)]
            gap = lambda x: pa.nulls(x, pa.int64())
            long = lambda x: pa.array(x.view(np.int64))
            cat = lambda *x: pa.concat_arrays(list(x))
            text = lambda c: cat(t.column(c).combine_chunks().cast(pa.string()).take(pa.array(at)), pa.nulls(k[1] + k[2], pa.string()))
            second = two[pair]
            yield T.batch(["kind", "lang", "word", "h1", "h2", "h3", "a", "m"], [
                np.repeat(np.array([1, 2, 3], np.int32), k), text("lang"), text("word"),
                cat(long(first), long(first[g[pair][two_at]]), long(first[g[three_at]])),
                cat(gap(k[0]), long(second[two_at]), long(two[three_at])),
                cat(gap(k[0] + k[1]), long(three[three_at])),
                cat(pa.array(f1), pa.array(f2[two_at]), pa.array(n[three_at])),
                cat(gap(k[0]), pa.array(m[two_at]), pa.array(np.repeat(f2, length)[three_at]))])

    rows = src.mapInArrow(emit, "h long, shard int, lang string, word string, nexts binary, counts binary")
    return (rows.repartition("h", "shard").sortWithinPartitions("h", "shard")
            .mapInArrow(merge, "kind int, lang string, word string, h1 long, h2 long, h3 long, a long, m long"))


def _score(a: Column, x: Column, y: Column) -> Column:
    """floor(1000000 * a * a / (x * y)), exact: 18-digit counts, 38-digit products."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", (wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)"),
                           (wide(x) * wide(y)).cast("decimal(38,0)")).cast("long")


def mine(docs: DataFrame, least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    rows = cut_to_table(merged(docs, least, lang_col, text_col))
    word = cut_to_table(rows.filter("kind = 1").groupBy("h1").agg(F.first("lang").alias("lang"), F.first("word").alias("word"), F.sum("a").alias("f")))
    size = word.groupBy("lang").agg(F.sum("f").alias("n"))
    word = word.filter(F.col("f") >= least)  # the parts of a candidate are as frequent as it
    pair = rows.filter("kind = 2").select("h1", "h2", "a", "m")
    triple = rows.filter("kind = 3").select("h1", "h2", "h3", "a", F.col("m").alias("l2"))
    named = lambda i, f: word.select(F.col("h1").alias(f"h{i}"), F.col("word").alias(f"w{i}"), F.col("f").alias(f), *(["lang"] if i == 1 else []))

    to_left = triple.groupBy("h2", "h3").agg(F.max("a").alias("m2")).select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "m2")
    free = (pair.join(cut_to_table(to_left), ["h1", "h2"], "left")
            .filter(F.lit(100) * F.greatest("m", F.coalesce("m2", F.lit(0))) < F.lit(subsumed) * F.col("a")))
    twos = (free.join(named(1, "l"), "h1").join(named(2, "r"), "h2")
            .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score")))

    rest = pair.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("r1"))
    cuts = (triple.join(rest, ["h2", "h3"]).join(named(1, "l1"), "h1").join(named(2, "f2"), "h2").join(named(3, "r2"), "h3")
            .withColumn("s1", _score(F.col("a"), F.col("l1"), F.col("r1"))).withColumn("s2", _score(F.col("a"), F.col("l2"), F.col("r2"))))
    early = F.col("s1") <= F.col("s2")
    pick = lambda x, y, name: F.when(early, F.col(x)).otherwise(F.col(y)).alias(name)
    threes = cuts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", pick("l1", "l2", "l"), pick("r1", "r2", "r"), pick("s1", "s2", "score"))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # the filter on the plain row number lets every task drop what cannot be among the first
    best = twos.unionByName(threes).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(size, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
