"""Language identification by mixture inference (operator 3).

Each language has a distribution over hashed byte trigrams of words, counted
over all labelled training rows.  A document is a mixture: expectation-
maximisation estimates the share of its words that each language explains, with
a uniform component for words of no learned language.  The language set is
chosen by penalised likelihood: languages join in the order of their shares
while each raises the log-likelihood by more than ``PENALTY`` * log(words); the
prediction is the language with the largest share, the share is the score.

Words of a whole Arrow slice are handled together, so EM steps are a few array
operations for thousands of documents at once.  A document's steps go on until
no share moves by more than ``TOLERANCE``; documents that stand still leave the
arrays.  EM over all languages bounds what any further language can add, so
further sets are tried only where that bound exceeds the penalty.

Edge cases: a text that is null or has no letter, or any text when no training
row exists, is ``und`` with score 0; equal shares go to the first language in
alphabetical order; a row with a null id is predicted but not learned from
(held_out false, as its remainder is unknown); repeated rows count repeatedly;
an empty table gives no rows; other input columns are ignored.  ``filter_known``
drops texts that are null or have no letter, since nothing in them is known;
without any learned language it keeps every row, as there is nothing to judge
by.  More than ``MOST_LANGUAGES`` different labels are an error: the model has
BUCKETS numbers for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.iterate import cut_to_table
from . import textops as T

BUCKETS = 1 << 16
SMOOTHING = 0.1
TOLERANCE = 1e-6  # EM stops for a document when no share moves by more
PENALTY = 2.0
MOST_LANGUAGES = 256

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class Grams:
    """Words with a letter of a slice of texts and the trigram buckets of
    every byte position: a word's trigrams are those that start one byte before
    it (its left neighbour counts as a space) up to its last byte but one."""

    def __init__(self, col: pa.Array):
        data, self.offsets = T.byte_view(col)
        self.n = len(self.offsets) - 1
        inside = T._WORD[data]
        s, e = T.spans(inside, self.offsets)
        letters = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_LETTER[data], out=letters[1:])
        has = letters[e] > letters[s]
        self.start, self.end = s[has], e[has]
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        d = np.full(len(data) + 2, 32, np.uint32)
        d[1:-1] = np.where(inside, T.lower_ascii(data), 32)
        # the byte before a text's first word belongs to another text
        code = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
        first = self.offsets[:-1][self.offsets[:-1] < len(data)]
        code[first] = (np.uint32(32) << np.uint32(16)) | (code[first] & np.uint32(0xFFFF))
        last = self.offsets[1:][self.offsets[1:] > 0] - 1
        code[last] = (code[last] & np.uint32(0xFFFF00)) | np.uint32(32)
        self.bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32)

    def positions(self) -> np.ndarray:
        """Byte positions (one per trigram) that lie in a word with a letter."""
        mark = np.zeros(len(self.bucket) + 1, np.int32)
        mark[self.start] += 1
        mark[self.end] -= 1  # words never touch
        return np.flatnonzero(np.cumsum(mark[:-1]))

    def word_scores(self, table: np.ndarray) -> np.ndarray:
        """Sum of ``table`` (a value per bucket) over each word's trigrams."""
        total = np.zeros(len(self.bucket) + 1)
        np.cumsum(table[self.bucket], out=total[1:])
        return total[self.end] - total[self.start]


def training(id_col: str = "doc_id") -> Column:
    """Rows that a model may learn from: crc32 of the id as text, mod 4, not 2."""
    return F.crc32(F.col(id_col).cast("string")) % 4 != 2


class Model:
    """Log-probability of every bucket in each learned language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTHING
        self.logp = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if len(langs) else counts
        self.other = -np.log(BUCKETS)

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray]:
        """Per text the language with the largest share, and that share."""
        return self.mixtures(col)[:2]

    def mixtures(self, col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Per text the language with the largest share, that share, and the
        sum of all learned languages' shares (the uniform component has the
        rest)."""
        g = Grams(col)
        names, score, known = ["und"] * g.n, np.zeros(g.n), np.zeros(g.n)
        if not self.langs or not len(g.start):
            return names, score, known
        count = np.bincount(g.doc, minlength=g.n)
        use = np.flatnonzero(count)
        k = len(self.langs)
        ll = np.empty((len(g.start), k + 1))
        for i in range(k):
            ll[:, i] = g.word_scores(self.logp[i])
        ll[:, k] = self.other * (g.end - g.start)
        top = ll.max(axis=1, keepdims=True)
        like = np.exp(ll - top)
        row = np.repeat(np.arange(len(use)), count[use])
        n = count[use].astype(float)
        share, most = _em(like, row, n)
        order = np.argsort(-share[:, :k], axis=1, kind="stable")
        best_share, best = np.zeros((len(use), k + 1)), np.full(len(use), -np.inf)
        price = PENALTY * np.log(n + 1)
        live = np.arange(len(use))
        for size in range(1, k + 1):  # languages join while they pay
            at = np.flatnonzero(np.isin(row, live)) if len(live) < len(use) else np.arange(len(row))
            own = np.searchsorted(live, row[at])
            columns = np.concatenate([order[live, :size], np.full((len(live), 1), k)], axis=1)
            share, fit = _em(np.take_along_axis(like[at], columns[own], axis=1), own, n[live])
            better = fit - size * price[live] > best[live]
            up = live[better]
            best[up] = fit[better] - size * price[up]
            filled = np.zeros((len(up), k + 1))
            np.put_along_axis(filled, columns[better], share[better], axis=1)
            best_share[up] = filled
            # no set beats the fit of all languages, and each further language costs the price
            live = up[most[up] - fit[better] > price[up]]
            if not len(live):
                break
        pick = best_share[:, :k].argmax(axis=1)
        letters = [any(map(str.isalpha, col[int(i)].as_py())) for i in use]
        for j, i in enumerate(use):
            if letters[j]:
                names[i], score[i], known[i] = self.langs[pick[j]], best_share[j, pick[j]], best_share[j, :k].sum()
        return names, np.clip(score, 0.0, 1.0), np.clip(known, 0.0, 1.0)


def _em(like: np.ndarray, row: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the components (columns of ``like``, a row per word) in each
    document, and the documents' log-likelihoods (up to a constant per word)."""
    docs, parts = len(n), like.shape[1]
    share = np.full((docs, parts), 1.0 / parts)
    live, words, own = np.arange(docs), like, row
    while len(live):
        first = np.searchsorted(own, np.arange(len(live)))
        size = n[live, None]
        now = share[live]
        while True:
            part = now[own]
            whole = np.maximum(np.einsum("ij,ij->i", words, part), 1e-300)
            r = words * part / whole[:, None]
            new = np.add.reduceat(r, first, axis=0) / size
            still = np.abs(new - now).max(axis=1) <= TOLERANCE
            now = new
            if 4 * still.sum() >= len(live) or still.all():
                break
        share[live] = now
        go = ~still
        keep = go[own]
        live, words, own = live[go], words[keep], (np.cumsum(go) - 1)[own[keep]]
    total = np.einsum("ij,ij->i", like, share[row])
    return share, np.add.reduceat(np.log(np.maximum(total, 1e-300)), np.searchsorted(row, np.arange(docs)))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts trigrams over all training rows with a language and a text; one
    number per language and bucket comes to the driver."""
    def task(batches):
        counts: dict[str, np.ndarray] = {}
        for b in T.pieces(batches, "text"):
            g = Grams(b.column("text"))
            pos = g.positions()
            lang = b.column("lang").dictionary_encode()
            own = lang.indices.to_numpy(zero_copy_only=False)[np.searchsorted(g.offsets, pos, side="right") - 1]
            for i, name in enumerate(lang.dictionary.to_pylist()):
                counts.setdefault(name, np.zeros(BUCKETS, np.int64))
                counts[name] += np.bincount(g.bucket[pos[own == i]], minlength=BUCKETS)
        for name, c in counts.items():
            at = np.flatnonzero(c)
            yield T.batch(["lang", "bucket", "n"], [pa.array([name] * len(at), pa.string()), at.astype(np.int32), c[at]])

    known = (docs.filter(training(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
             .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")))
    counted = cut_to_table(known.mapInArrow(task, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    langs = sorted(r.lang for r in counted.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in {lang_col}")
    rows = counted.toPandas()
    counts = np.zeros((len(langs), BUCKETS))
    counts[[langs.index(x) for x in rows["lang"]], rows["bucket"]] = rows["n"]
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers

    def task(batches):
        for b in T.pieces(batches, "text"):
            names, score = shared.value.predict(b.column("text"))
            yield T.batch(["doc_id", "held_out", "lang_pred", "score"],
                          [b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), score])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(~training(id_col), F.lit(False)).alias("held_out"),
                      F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(task, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def filter_known(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Documents in which the learned languages together explain at least
    ``least`` of the words; all columns and rows that stay are unchanged.
    Texts that are null or have no letter go; if no language could be learned
    (no training row has a label and a text) every row stays."""
    learned = fit(docs, id_col, text_col, lang_col)
    if not learned.langs:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(learned)

    def task(batches):
        for b in T.pieces(batches, text_col):
            names, _, known = model.value.mixtures(b.column(text_col))
            yield b.filter(pa.array([n != "und" and s >= least for n, s in zip(names, known)]))

    return docs.mapInArrow(task, docs.schema)
