"""Personal data by a skip-chain conditional random field (operator 2).

Nodes of a document's field are its mentions: the spans of the base rules, and
candidates (digit strings of 7 to 19 digits, host-less or spelled-out mail
addresses) that no base rule accepts.  Labels are none, email, ip, card, phone.
Potentials:

* node: a softmax over binary shape features,
* chain: between neighbouring mentions, by how often labels follow each other,
* skip: between successive mentions with the same or a similar value (same
  local part, same last nine digits), and between each candidate and the nearest
  base mention of its value, rewarding equal labels.

Base mentions are observed; loopy sum-product message passing, run until the
messages stand still, finds the marginals of the candidates, so a number that is
a phone once is a phone wherever and however often it is written another way in
the same document.  A candidate whose most likely
label is a kind of personal data becomes a span of that kind.

All potentials are estimated from counts of (features, label), label pairs and
skip agreements over the whole corpus; the counts' sizes depend on the feature
set alone.

Edge cases: a null text is empty and has no spans; spans are in code points,
end exclusive; matches of a rule do not overlap (leftmost first), a match that
fails its test is dropped without a retry; null ids and repeated rows are
scanned row by row; an empty table gives no rows; other input columns are
ignored.  Long runs without a match cost linear time.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
FEATURES = ("at_sign", "plus", "dots3", "round", "dash", "space", "letters",
            "digits7_8", "digits9_15", "digits13_19", "luhn", "spelled_at")
STILL = 1e-3  # messages that would move less than this stand still
LEAST = 0.5  # marginal that a candidate's label needs

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"\+?[0-9](?:[\x20().-]{0,2}[0-9])++")
_SPELLED = re.compile(r"(?:\x20?[(\[]at[)\]]\x20?)([A-Za-z0-9-]+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]+)*)")
_HOST = re.compile(r"[A-Za-z0-9-]+")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _local_start(text: str, at: int, least: int) -> int:
    """Start of the local part that ends at ``at``, not before ``least``."""
    i = at
    while i > least and text[i - 1] in _LOCAL_CHARS:
        i -= 1
    return i


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their @ signs: a match's
    local part is the whole run before its @, down to the previous match."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m and at > end and text[at - 1] in _LOCAL_CHARS:
            out.append((_local_start(text, at, end), m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans, by kind as listed, then start."""
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    if _has_digit(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if max(map(_part, m.group().split("."))) <= 255]
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 37:
                d = _DIGITS.sub("", m.group())
                if 13 <= len(d) <= 19 and luhn(d):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return out


_ANY_DIGIT = re.compile("[0-9]")


def _has_digit(text: str) -> bool:
    return _ANY_DIGIT.search(text) is not None


def _part(s: str) -> int:
    s = s.lstrip("0")
    return int(s or 0) if len(s) < 4 else 999


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Spans that may be personal data and overlap no base span."""
    found = []
    if _has_digit(text):
        for m in _NUMBER.finditer(text):
            if 7 <= m.end() - m.start() <= 60 and 7 <= len(_DIGITS.sub("", m.group())) <= 19:
                found.append(m.span())
    end, at = 0, text.find("@")
    while at >= 0:
        m = _HOST.match(text, at + 1)
        if m and at > end and text[at - 1] in _LOCAL_CHARS:
            found.append((_local_start(text, at, end), m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if "at)" in text or "at]" in text:
        for m in _SPELLED.finditer(text):
            s = _local_start(text, m.start(), 0 if not found else max((e for _, e in found if e <= m.start()), default=0))
            if s < m.start():
                found.append((s, m.end()))
    out, last, busy, k = [], 0, sorted((s, e) for _, s, e in taken), 0
    reach = np.maximum.accumulate([e for _, e in busy]).tolist() if busy else []
    starts = [s for s, _ in busy]
    for s, e in sorted(found):
        k = int(np.searchsorted(starts, e)) if busy else 0
        if s >= last and not (k and reach[k - 1] > s):
            out.append((s, e))
            last = e
    return out


def shape(value: str) -> int:
    """The features of a mention's text as a bit mask, in FEATURES' order."""
    d = _DIGITS.sub("", value)
    n = len(d)
    flags = ("@" in value, value.startswith("+"), value.count(".") == 3, "(" in value and "at" not in value, "-" in value, " " in value,
             any(c.isalpha() for c in value), 7 <= n <= 8, 9 <= n <= 15, 13 <= n <= 19, 13 <= n <= 19 and luhn(d),
             "(at)" in value or "[at]" in value)
    return sum(1 << i for i, x in enumerate(flags) if x)


def link_key(value: str) -> str:
    """Mentions with equal keys share a skip potential."""
    if "@" in value or "(at)" in value or "[at]" in value:
        return "e" + re.split(r"@|\x20?[(\[]at", value, maxsplit=1)[0].lower()
    if value.count(".") == 3 and not re.search(r"[^0-9.]", value):
        return "i" + value
    return "d" + _DIGITS.sub("", value)[-9:]


def mentions(text: str):
    """(base spans, nodes); a node is (start, end, label or -1, shape, key),
    sorted by start.  Label -1: a candidate."""
    base = base_spans(text)
    nodes = [(s, e, LABELS.index(k)) for k, s, e in base] + [(s, e, -1) for s, e in candidates(text, base)]
    return base, [(s, e, y, shape(text[s:e]), link_key(text[s:e])) for s, e, y in sorted(nodes)]


def _skips(nodes) -> list[tuple[int, int]]:
    """Successive nodes with equal keys, and each candidate with the nearest
    base mention of its key: at most two edges a node, not all pairs."""
    groups: dict[str, list[int]] = {}
    for i, x in enumerate(nodes):
        groups.setdefault(x[4], []).append(i)
    out = set()
    for own in groups.values():
        out.update(zip(own, own[1:]))
        base = [i for i in own if nodes[i][2] >= 0]
        k = 0
        for i in own if base else ():
            while k + 1 < len(base) and abs(base[k + 1] - i) < abs(base[k] - i):
                k += 1
            if nodes[i][2] < 0:
                out.add((min(i, base[k]), max(i, base[k])))
    return sorted(out)


class Field:
    """The potentials, in logarithms."""

    def __init__(self, counts: Counter):
        k = len(LABELS)
        seen = [(s, y, n) for (what, s, y), n in counts.items() if what == "node"]
        x = np.array([[1.0, *((s >> i) & 1 for i in range(len(FEATURES)))] for s, _, _ in seen]).reshape(-1, len(FEATURES) + 1)
        y = np.array([b for _, b, _ in seen], dtype=int)
        # a shape seen very often must not drown the others
        n = np.log1p(np.array([c for _, _, c in seen], dtype=float))
        self.weights = np.zeros((len(FEATURES) + 1, k))
        if len(seen):
            onehot = np.eye(k)[y]
            for _ in range(400):
                z = x @ self.weights
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                grad = x.T @ ((onehot - p) * n[:, None]) / n.sum() - 0.02 * self.weights
                self.weights += grad
        chain = np.ones((k, k))
        for (what, a, b), c in counts.items():
            if what == "chain":
                chain[a, b] += c
        chain = chain / chain.sum(axis=1, keepdims=True)
        self.chain = 0.25 * (np.log(chain) - np.log(chain.mean(axis=0, keepdims=True)))
        same, other = counts[("skip", 1, 0)], counts[("skip", 0, 0)]
        self.skip = float(np.clip(np.log((same + 1.0) / (other + 1.0)), 2.0, 6.0))

    def node(self, shapes: np.ndarray) -> np.ndarray:
        bits = np.concatenate([np.ones((len(shapes), 1)), (shapes[:, None] >> np.arange(len(FEATURES))) & 1], axis=1)
        return bits @ self.weights

    def marginals(self, nodes) -> np.ndarray:
        """Loopy sum-product over chain and skip edges, all edges at once, until
        the messages stand still.  Messages that swing get smaller steps; where
        they swing even at steps of 1/64, which sum-product does not exclude,
        the beliefs are the average over that last run, so one text never ends
        the job."""
        k = len(LABELS)
        local = self.node(np.array([x[3] for x in nodes]))
        seen = np.array([x[2] for x in nodes])
        local[seen >= 0] = -50.0
        local[seen >= 0, seen[seen >= 0]] = 0.0
        pairs = [(i, i + 1) for i in range(len(nodes) - 1)]
        skips = _skips(nodes)
        edge = np.array(pairs + skips, dtype=int).reshape(-1, 2)
        pot = np.concatenate([np.broadcast_to(self.chain, (len(pairs), k, k)), np.broadcast_to(self.skip * np.eye(k), (len(skips), k, k))])
        src = np.concatenate([edge[:, 0], edge[:, 1]])
        dst = np.concatenate([edge[:, 1], edge[:, 0]])
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edge)) + len(edge), np.arange(len(edge))])
        msg = np.zeros((len(src), k))
        belief = local
        step, rounds, calm = 0.5, 0, 100 + 4 * len(nodes)  # (a message crosses an edge a round)
        total = np.zeros_like(local)
        while len(src):
            cavity = belief[src] - msg[back]
            joint = cavity[:, :, None] + pot
            top = joint.max(axis=1, keepdims=True)
            new = (top + np.log(np.exp(joint - top).sum(axis=1, keepdims=True)))[:, 0]
            new -= new.max(axis=1, keepdims=True)
            new[seen[dst] >= 0] = 0.0  # no number of messages moves an observed label
            moved = np.abs(new - msg).max()
            msg = msg + step * (new - msg)
            belief = local.copy()
            np.add.at(belief, dst, msg)
            if moved < STILL:
                break
            rounds, total = rounds + 1, total + belief
            if rounds == calm:
                if step <= 1 / 64:
                    belief = total / rounds
                    break
                step, rounds, total = step / 2, 0, np.zeros_like(local)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def spans(self, text: str) -> tuple[list, list]:
        """(base spans, all spans), each by kind as listed, then start."""
        base, nodes = mentions(text)
        added = []
        if any(x[2] < 0 for x in nodes):
            p = self.marginals(nodes)
            for x, q in zip(nodes, p):
                best = int(q.argmax())
                if x[2] < 0 and best and q[best] >= LEAST:
                    added.append((LABELS[best], x[0], x[1]))
        return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1])) if added else base


def fit(docs: DataFrame, text_col: str = "text") -> Field:
    """Counts over all documents; at most one row per (shape, label), label
    pair and skip outcome comes to the driver.  Base mentions carry their
    kind as label; candidates count as none, and skips are counted between
    base mentions."""
    def task(batches):
        counts: Counter = Counter()
        for b in T.pieces(batches, "text"):
            for text in b.column("text").to_pylist():
                if not text or not ("@" in text or _has_digit(text) or "at)" in text or "at]" in text):
                    continue
                nodes = mentions(text)[1]
                y = [max(x[2], 0) for x in nodes]
                for x, label in zip(nodes, y):
                    counts[("node", x[3], label)] += 1
                for pair in zip(y, y[1:]):
                    counts[("chain", *pair)] += 1
                for i, j in _skips(nodes):
                    if nodes[i][2] >= 0 and nodes[j][2] >= 0:
                        counts[("skip", int(y[i] == y[j]), 0)] += 1
        keys = list(counts)
        yield T.batch(["what", "a", "b", "n"], [pa.array([x[0] for x in keys], pa.string()), pa.array([x[1] for x in keys], pa.int32()),
                                               pa.array([x[2] for x in keys], pa.int32()), pa.array([counts[x] for x in keys], pa.int64())])

    rows = (docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(task, "what string, a int, b int, n long")
            .groupBy("what", "a", "b").agg(F.sum("n").alias("n")).orderBy("what", "a", "b").collect())
    return Field(Counter({(r.what, r.a, r.b): r.n for r in rows}))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    def task(batches):
        for b in T.pieces(batches, "text"):
            found = [field.spans(t or "") for t in b.column("text").to_pylist()]
            yield T.batch(["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"], [
                b.column("doc_id"), *(pa.array([sum(x[0] == k for x in own) for own, _ in found], pa.int64()) for k in KINDS),
                pa.array([hashlib.sha256(joined(own).encode()).hexdigest() for own, _ in found], pa.string()),
                pa.array([joined(every) for _, every in found], pa.string())])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(task, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
