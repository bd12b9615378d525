"""Quality rules: base filters and learned decision lists (operator 10).

Statistics of every text come from vectorised passes over Arrow batches.
A decision list is learned by sequential covering: each rule is a conjunction
of thresholds on statistics, grown by information gain on one part of the
labelled rows and pruned on the other; the ordered rules become one Spark
``CASE WHEN`` expression, so applying them is plain column arithmetic.

Edge cases: a null or empty text has all counts 0 and fails the base rule
(fewer than 10 words); null ids and repeated rows are judged row by row;
without labels (empty table, null labels only) no rule is learned and only
the base rule decides; other input columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.iterate import cut_to_table
from . import textops as T

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_chars", "n_lines", "n_distinct", "n_digits", "n_upper"]
SAMPLE_ROWS = 20_000  # labelled rows that a list is learned from, at most
WINDOW = 5

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_HEAD = np.arange(256) & 0xC0 != 0x80  # first byte of a code point
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LINE = np.ones(256, bool)
_LINE[10] = False


def _repeated(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which (doc, h) occur twice or more."""
    key = T.mix(h ^ T.mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k), bool)
    eq = k[1:] == k[:-1]
    same[1:] |= eq
    same[:-1] |= eq
    out = np.zeros(len(k), bool)
    out[order] = same
    return out


def _later(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which (doc, h) equal an earlier one."""
    key = T.mix(h ^ T.mix(doc.astype(np.uint64) + np.uint64(1)))
    out = np.ones(len(key), bool)
    out[np.unique(key, return_index=True)[1]] = False
    return out


def count_texts(col: pa.Array) -> dict[str, np.ndarray]:
    """The statistics in COUNTS for every text of a slice."""
    w = T.Words(col)
    heads = _HEAD[w.data]
    pos, h = w.windows(WINDOW)
    again = pos[_repeated(w.doc[pos], h)]
    covered = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + WINDOW, -1)
    covered = np.cumsum(covered)[:-1] > 0
    ls, le = T.spans(_LINE[w.data], w.offsets)
    upto = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(w.inside, out=upto[1:])
    wordy = upto[le] > upto[ls]
    ls, le = ls[wordy], le[wordy]
    ldoc = np.searchsorted(w.offsets, ls, side="right") - 1
    dup = _later(ldoc, T.run_hashes(w.data, ls, le))
    by = lambda doc: np.bincount(doc, minlength=w.n)[:w.n].astype(np.int64)
    return {
        "n_words": w.count.astype(np.int64),
        "word_chars": T.per_text(w.inside & heads, w.offsets),
        "n_symbols": T.per_text(_IS_SYMBOL[w.data], w.offsets),
        "n_dup_lines": by(ldoc[dup]),
        "n_repeat_words": by(w.doc[covered]),
        "n_chars": T.per_text(heads, w.offsets),
        "n_lines": by(ldoc),
        "n_distinct": by(w.doc[~_later(w.doc, w.hash)]),
        "n_digits": T.per_text(_DIGIT[w.data], w.offsets),
        "n_upper": T.per_text(_UPPER[w.data], w.offsets),
    }


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and the statistics in COUNTS."""
    def task(batches):
        for b in T.pieces(batches, "text"):
            stats = count_texts(b.column("text"))
            yield T.batch(["doc_id", *COUNTS], [b.column("doc_id"), *(stats[c] for c in COUNTS)])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(task, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def counts(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in COUNTS}


def base_failed(c: dict[str, Column] | None = None) -> Column:
    c = c or counts()
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def features(c: dict[str, Column] | None = None) -> dict[str, Column]:
    """Size-free ratios of the statistics, as Spark columns."""
    c = {k: v.cast("double") for k, v in (c or counts()).items()}
    per = lambda a, b: c[a] / F.greatest(c[b], F.lit(1.0))
    return {
        "n_words": c["n_words"],
        "word_length": per("word_chars", "n_words"),
        "symbol_share": per("n_symbols", "n_chars"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "distinct_share": per("n_distinct", "n_words"),
        "digit_share": per("n_digits", "n_chars"),
        "upper_share": per("n_upper", "n_chars"),
        "line_words": per("n_words", "n_lines"),
    }


class DecisionList:
    """Ordered rules; each is a list of (feature, "<=" or ">", threshold) whose
    conjunction means "bad".  Rows that meet no rule are good."""

    def __init__(self, rules: list[list[tuple[str, str, float]]]):
        self.rules = rules

    def keep_expr(self, feats: dict[str, Column] | None = None) -> Column:
        """The list as one ordered Spark conditional: true means keep."""
        f = feats or features()
        chain = None
        for rule in self.rules:
            test = None
            for name, op, t in rule:
                one = f[name] <= F.lit(t) if op == "<=" else f[name] > F.lit(t)
                test = one if test is None else test & one
            chain = F.when(test, F.lit(False)) if chain is None else chain.when(test, F.lit(False))
        return F.lit(True) if chain is None else chain.otherwise(F.lit(True))

    def keep(self, x: dict[str, np.ndarray]) -> np.ndarray:
        """The same on numpy columns."""
        bad = np.zeros(len(next(iter(x.values()))), bool)
        for rule in self.rules:
            bad |= _holds(rule, x)
        return ~bad

    def __str__(self) -> str:
        return "\n".join("bad if " + " and ".join(f"{n} {o} {t:.6g}" for n, o, t in r) for r in self.rules)


def _holds(rule, x) -> np.ndarray:
    ok = np.ones(len(next(iter(x.values()))), bool)
    for name, op, t in rule:
        ok &= x[name] <= t if op == "<=" else x[name] > t
    return ok


def _best_cut(x: dict[str, np.ndarray], inside: np.ndarray, bad: np.ndarray, min_bad: int):
    """The threshold (name, op, value) of the largest information gain over all
    midpoints between neighbouring values, or None."""
    b = bad[inside]
    p0, all0 = int(b.sum()), len(b)
    best, term = 1e-9, None
    for name, v in x.items():
        order = np.argsort(v[inside], kind="stable")
        vs, low = v[inside][order], np.cumsum(b[order])
        at = np.flatnonzero(vs[1:] > vs[:-1])
        below = (at + 1, low[at])
        for op, size, p in (("<=", *below), (">", all0 - below[0], p0 - below[1])):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p >= min_bad, p * (np.log2(p / size) - math.log2(p0 / all0)), 0.0)
            if len(gain) and gain.max() > best:
                i = int(gain.argmax())
                best, term = float(gain[i]) + 1e-9, (name, op, float((vs[at[i]] + vs[at[i] + 1]) / 2))
    return term


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, grow: np.ndarray, min_bad: int = 5, min_precision: float = 0.9) -> DecisionList:
    """Sequential covering on rows ``x`` labelled ``bad``; rows with ``grow``
    grow rules, the others prune and judge them.

    A rule is grown by adding the threshold of the largest information gain
    until it covers no good row or no threshold with ``min_bad`` bad rows gains
    anything; its last terms are then cut while that does not lower
    (bad - good) / (bad + good) on the pruning rows.  Covering ends when fewer
    than ``min_bad`` bad rows are left, or at the first rule that is less
    precise on the pruning rows than ``min_precision``."""
    left = np.ones(len(bad), bool)
    rules = []
    while (bad & left & grow).sum() >= min_bad:
        rule, inside = [], left & grow
        while (inside & ~bad).any():
            term = _best_cut(x, inside, bad, min_bad)
            if term is None:
                break
            rule.append(term)
            inside = inside & _holds([term], x)
        if not rule:
            break
        hold = left & ~grow

        def worth(r):
            cover = hold & _holds(r, x)
            p, n = (cover & bad).sum(), (cover & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        cover = hold & _holds(rule, x)
        p, n = (cover & bad).sum(), (cover & ~bad).sum()
        if p == 0 or p / (p + n) < min_precision:
            break
        rules.append(rule)
        left &= ~_holds(rule, x)
    return DecisionList(rules)


def fit_list(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
             sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """Learn a list from labelled statistics (label 0: bad, 1: good).

    About ``sample_rows`` labelled rows at most, by a hash of their ids, come
    to the driver; rows that the base rule rejects are left out, since the
    list only has to judge the others."""
    lab = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("_label")) \
        .filter("doc_id is not null and _label is not null").groupBy("doc_id").agg(F.min("_label").alias("_label"))
    f = features()
    known = stats.filter(~base_failed()).join(lab, "doc_id").withColumn("_h", F.xxhash64("doc_id"))
    n = known.count()
    if n > sample_rows:
        known = known.filter(F.pmod(F.col("_h"), F.lit(1 << 30)) < F.lit((1 << 30) * sample_rows // n))
    rows = known.select("_h", (F.col("_label") == 0).alias("_bad"), *(c.alias(f"_{n}") for n, c in f.items())).toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")
    if rows.empty:
        return DecisionList([])
    x = {n: rows[f"_{n}"].to_numpy(dtype=float) for n in f}
    return learn_list(x, rows["_bad"].to_numpy(dtype=bool), (rows["_h"] % 3 != 0).to_numpy())


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to a table of statistics."""
    failed = base_failed()
    return stats.withColumns({"base_failed": failed, "kept": ~failed & rules.keep_expr()})


def filter_kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the base rule and a list learned from ``labels``
    keep, with all their columns; statistics and verdict are computed where the
    rows lie."""
    mark = "_quality_"

    def task(batches):
        for b in T.pieces(batches, text_col):
            stats = count_texts(b.column(text_col))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(stats[c]) for c in COUNTS)],
                                             names=[*b.schema.names, *(mark + c for c in COUNTS)])

    rules = fit_list(cut_to_table(text_stats(docs, id_col, text_col)), labels)
    own = counts(mark)
    schema = StructType([*docs.schema.fields, *(StructField(mark + c, LongType()) for c in COUNTS)])
    return docs.mapInArrow(task, schema).filter(~base_failed(own) & rules.keep_expr(features(own))).select(*docs.columns)
