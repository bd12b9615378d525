"""Language-model scoring by a weighted backoff automaton (operator 12).

The model is a bigram model with Witten-Bell smoothing, learned from the
training documents: of a history h with c(h) occurrences and t(h) different
continuations,

    P(w | h) = (c(h, w) + t(h) P(w)) / (c(h) + t(h)),
    P(w) = (c(w) + 1/2) / (N + (V + 1) / 2),

where one of the V + 1 places is for all unknown words.  As an automaton: a
state for the text's start and one for each known word, a root, arcs (h, w) with
log P(w | h) for the seen pairs, and from every state a failure arc to the root
with the weight log(t(h) / (c(h) + t(h))).  The root reads any word with log
P(w); after a word the automaton is in that word's state, or in the root if the
word is unknown.  A text is one traversal from left to right, and ends with an
arc that reads the end token.

The model grows with the corpus and is nowhere whole.  Documents are dealt into
blocks of about ``BLOCK`` bytes by a hash.  A block asks for what its texts
need: it sends a stripe (next word -> count in its training texts) for every
word that occurs in it, packed into a row for each bucket of prefixes.  A
bucket merges the stripes of all blocks elementwise and answers each block with
the merged counts in the order of its question, and with its part of N and V.
The block joins the answers into the part of the automaton that its texts can
reach, exact as the whole.  Very frequent prefixes are split by the next word,
so neither a block nor a bucket grows with the corpus.

Edge cases: a null or empty text is scored as its end token alone; a null id is
scored but not learned from (held_out false, as its remainder is unknown);
repeated rows count repeatedly; a very long text is one block of its own size;
without training documents every token has probability 1 (the unknown place has
it all); an empty table gives no rows; other input columns are ignored.  Two
words with one 64-bit hash (told apart by length and edge bytes) are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stripes as S
from . import textops as T

BLOCK = 9 << 20  # bytes of text in a block

_END, _START = 0, 1  # in place of a word's hash


def remainder(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5


class Tokens:
    """The tokens of some texts in a row: ``word`` and ``before`` (hashes; the
    word before, or the start), ``check``, ``doc``."""

    def __init__(self, batches):
        word, before, check, size = [], [], [], []
        for b in batches:
            w = T.Words(b.column("text"), lower=True)
            n = len(w.hash) + w.n
            last = w.first[1:] + np.arange(w.n)  # where each text's end token lies
            inner = np.ones(n, bool)
            inner[last] = False
            own = np.full(n, _END, np.int64)
            own[inner] = w.hash.view(np.int64)
            tag = np.zeros(n, np.int64)
            length = w.end - w.start
            tag[inner] = ((length & 0x7FFF) << 16) | (w.data[w.start].astype(np.int64) << 8) | w.data[w.end - 1]
            left = np.empty(n, np.int64)
            left[1:] = own[:-1]
            left[np.concatenate([[0], last[:-1] + 1])] = _START
            word.append(own), before.append(left), check.append(tag), size.append(w.count + 1)
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.word, self.before, self.check, self.size = cat(word), cat(before), cat(check), cat(size)
        self.doc = np.repeat(np.arange(len(self.size)), self.size)


class Question:
    """The stripes of a block, in the order of (bucket, prefix, shard, next):
    ``prefix``/``next`` codes and ``seen`` (count in training texts) of each
    pair, ``pair`` of each token, and of each stripe its ``bucket``,
    ``owner`` (prefix code), ``shard`` and ``size``."""

    def __init__(self, t: Tokens, learn: np.ndarray, hot: dict[int, int], buckets: int):
        self.vocab, first, code = np.unique(np.append(t.word, _START), return_index=True, return_inverse=True)
        check = np.append(t.check, 0)
        self.check = check[first]
        if (check != self.check[code]).any():
            raise ValueError("two words have the same 64-bit hash")
        self.word = code[:-1]
        left = np.empty(len(t.word), np.int64)
        left[1:] = self.word[:-1]
        left[t.before == _START] = code[-1]
        v = len(self.vocab)
        key, pair = np.unique(left * v + self.word, return_inverse=True)
        seen = np.bincount(pair, weights=learn[t.doc], minlength=len(key)).astype(np.uint32)
        prefix, following = key // v, key % v
        hashes = self.vocab.view(np.uint64)
        shard = S.shard_of(hashes[prefix], hashes[following], hot)
        most = max([1, *hot.values()])
        stripe = self._key(prefix, shard, most, buckets)
        order = np.argsort(stripe, kind="stable")
        self.prefix, self.next, self.seen = prefix[order], following[order], seen[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair = place[pair]
        # every shard of a hot prefix answers with its part of the prefix's count
        heavy = np.flatnonzero(np.isin(self.vocab, np.array(list(hot), np.int64)) & (self.vocab != _END))
        parts = np.array([hot[int(x)] for x in self.vocab[heavy]], np.int64)
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        whole = self._key(np.repeat(heavy, parts), number, most, buckets)
        stripe = stripe[order]
        stripes = np.unique(np.concatenate([stripe, whole]))
        self.size = np.searchsorted(stripe, stripes, side="right") - np.searchsorted(stripe, stripes)
        self.shard, self.owner, self.bucket = stripes % most, stripes // most % v, stripes // most // v

    def _key(self, prefix, shard, most, buckets):
        bucket = (T.mix(self.vocab.view(np.uint64)[prefix] + np.uint64(0x9E3779B97F4A7C15) * (shard.astype(np.uint64) + np.uint64(1))) % np.uint64(buckets)).astype(np.int64)
        return (bucket * len(self.vocab) + prefix) * most + shard

    def rows(self, block: int, buckets: int) -> pa.RecordBatch:
        """A row for every bucket, also for those without a stripe."""
        ends = np.searchsorted(self.bucket, np.arange(buckets), side="right")
        last = np.append(0, np.cumsum(self.size))[ends]
        return T.batch(_names(_QUESTION), [
            np.arange(buckets, dtype=np.int32), np.full(buckets, block, np.int32),
            S.as_binary(self.vocab[self.owner], ends), S.as_binary(self.shard.astype(np.int32), ends), S.as_binary(self.check[self.owner].astype(np.int32), ends),
            *S.halves(self.size, ends), S.as_binary(self.vocab[self.next], last), *S.halves(self.seen, last)])


# Sizes and counts travel as low bytes and the rest (``stripes.halves``).
_QUESTION = "bucket int, block int, owners binary, shards binary, checks binary, sizes binary, sizes_high binary, nexts binary, counts binary, counts_high binary"
_ANSWER = "block int, bucket int, n long, v long, occurs binary, occurs_high binary, kinds binary, kinds_high binary, counts binary, counts_high binary"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def answer(t: pa.Table, hot: dict[int, int]) -> pa.Table:
    """Merge the stripes that all blocks sent to a bucket: for each block the
    occurrences and kinds of its stripes' prefixes, the count of each of its
    pairs, and the bucket's tokens and known words (those of hot prefixes and
    the end are counted by the block)."""
    owner, stripes = S.entries(t.column("owners"), np.int64)
    shard, check = S.entries(t.column("shards"), np.int32)[0], S.entries(t.column("checks"), np.int32)[0]
    size, n = (S.whole(t.column(c), t.column(f"{c}_high")) for c in ("sizes", "counts"))
    following, pairs = S.entries(t.column("nexts"), np.int64)
    order = np.lexsort((shard, owner))
    at = S.starts(owner[order], shard[order])
    mark = np.zeros(len(order), np.int64)
    mark[at[1:]] = 1
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(mark)
    if (check != check[order][at][group] if len(at) else check != 0).any():
        raise ValueError("two words have the same 64-bit hash")
    g = np.repeat(group, size)
    o = np.lexsort((following, g))
    first = S.starts(g[o], following[o])
    total = np.add.reduceat(n[o], first) if len(first) else n
    merged = np.empty(len(n), np.int64)
    merged[o] = np.repeat(total, np.diff(np.append(first, len(o))))
    occurs = np.bincount(g[o][first], weights=total, minlength=len(at)).astype(np.int64)
    kinds = np.bincount(g[o][first], weights=total > 0, minlength=len(at)).astype(np.int64)
    name = owner[order][at]
    word = name != _START
    known = (occurs > 0) & word & ~np.isin(name, np.array(list(hot), np.int64))
    ends, last, m = np.cumsum(stripes), np.cumsum(pairs), t.num_rows
    return pa.table([t.column("block"), t.column("bucket"), pa.array(np.full(m, occurs[word].sum(), np.int64)), pa.array(np.full(m, known.sum(), np.int64)),
                     *S.halves(occurs[group], ends), *S.halves(kinds[group], ends), *S.halves(merged, last)], names=_names(_ANSWER))


class Automaton:
    """The part of the automaton that a block's texts reach.  States are the
    codes of the block's vocabulary (the start's among them) and the root."""

    def __init__(self, q: Question, answers: pa.Table, hot: dict[int, int]):
        a = answers.sort_by("bucket")
        occurs, kinds, count = (S.whole(a.column(c), a.column(f"{c}_high")) for c in ("occurs", "kinds", "counts"))
        if len(occurs) != len(q.owner) or len(count) != len(q.prefix):
            raise RuntimeError("answers do not fit a block's question")
        v = len(q.vocab)
        c, t = (np.bincount(q.owner, weights=x, minlength=v) for x in (occurs, kinds))
        start, end = np.searchsorted(q.vocab, _START), np.searchsorted(q.vocab, _END)
        own = c.copy()
        own[end], own[start] = c[start], 0  # a text has one start and one end
        self.known = own > 0
        self.n = int(sum(a.column("n").to_pylist()) + c[start])
        words = int(sum(a.column("v").to_pylist())) + len(hot.keys() - {_START}) + int(c[start] > 0)
        p = (own + 0.5) / (self.n + 0.5 * (words + 1))
        self.root = np.log10(p)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.fail = np.where(c > 0, np.log10(t / (c + t)), 0.0)  # what is no state fails at no cost: it is the root
            arc = np.log10((count + t[q.prefix] * p[q.next]) / (c + t)[q.prefix])
        self.arc = np.where(count > 0, arc, self.fail[q.prefix] + self.root[q.next])

    def walk(self, q: Question, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, root weights and path weights of each text.  The state
        that a token is read in is the word before it, so the step of each token
        is its pair's: the arc, or the failure arc and the root's."""
        first = np.cumsum(size) - size
        add = lambda x: np.add.reduceat(x, first)
        return add(self.known[q.word].astype(np.int64)), add(self.root[q.word]), add(self.arc[q.pair])


def score(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(remainder(id_col) == 1, F.lit(False)).alias("held_out"),
                      F.coalesce(remainder(id_col) != 1, F.lit(False)).alias("learn"), text.alias("text"))
    size = src.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    blocks = max(1, -(-size // block))
    share = S.least_share(spark)

    def count(batches):
        for b in T.pieces(batches, "text"):
            yield S.frequent(Tokens([b]).before.view(np.uint64), share)

    hot = S.hot_words(src.filter("learn").select("text").mapInArrow(count, "h long, n long"), share)
    dealt = src.withColumn("block", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(blocks)).cast("int")).repartition("block")

    def question(t: pa.Table) -> tuple[Question, np.ndarray]:
        learn = np.asarray(t.column("learn").to_numpy(), np.float64)
        tokens = Tokens(T.pieces(t.to_batches(), "text"))
        return Question(tokens, learn, hot, blocks), tokens.size

    def ask(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([question(t)[0].rows(t.column("block")[0].as_py(), blocks)])

    def read(t: pa.Table, answers: pa.Table) -> pa.Table:
        q, n = question(t)
        a = Automaton(q, answers, hot)
        known, base, own = a.walk(q, n)
        return pa.table({"doc_id": t.column("doc_id"), "held_out": t.column("held_out"), "n_tokens": n, "n_known": known,
                         "train_tokens": np.full(len(n), a.n, np.int64), "base_score": base, "score": own})

    answers = dealt.groupBy("block").applyInArrow(ask, _QUESTION).groupBy("bucket").applyInArrow(lambda t: answer(t, hot), _ANSWER)
    kind = docs.schema[id_col].dataType.simpleString()
    return (dealt.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(read, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
