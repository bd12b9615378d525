"""Secret scans by trigram inverted index (operator 8).

Each rule is a regular expression.  From its parse tree we derive a Boolean
query over trigrams that every matching text must contain.  Documents are
indexed in blocks (an index partitioned by document, as search engines do):
for the trigrams that some query names, a block's postings list the documents
holding them; the query is evaluated by intersecting and uniting postings, and
only the documents left are verified with the expression itself.  A rule
without mandatory trigrams has the query "all" and scans the whole block.
Indexing, search and verification of a block happen in one task, so no text is
shuffled and no postings list grows beyond a block.

Edge cases: a null text is empty and has no spans; spans are in code points,
end exclusive; matches of a rule do not overlap (leftmost first) and a match
that fails the rule's test is dropped without a retry; a private key's span covers
its body and END line; null ids and repeated rows are scanned row by row; other
input columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from re import _constants as C
from re import _parser as P
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1  # its least length
    any_case: bool = False
    replaced: int = 0  # the group that redaction replaces


# The base rules of the operator's contract, in their order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
# A private key runs from its BEGIN line to its END line.  Where the next dashes
# are no END line, it runs over header lines and base64 pieces with what may stand
# between them (line breaks also as escapes, quotes, indents); a piece shorter than
# 16 ends it, and stands alone only at the text's end.  No part passes five dashes, so texts
# with very many BEGIN lines cost linear time.
_GAP = r"""(?:\\[nrt]|[\s\\>"'`+,;#|*/<]|-(?!-))*+"""
_NO_DASHES = r"[^-]*+(?:-(?!----)[^-]*+)*+"
_KEY_HEADERS = rf"(?:{_GAP}[A-Za-z][A-Za-z-]*+:(?:[^\r\n\\-]|-(?!----))*+)*+"
_KEY_BODY = rf"(?:{_GAP}[A-Za-z0-9+/]{{16,}}+={{0,2}})++(?:{_GAP}[A-Za-z0-9+/]++={{0,2}})?+|{_GAP}[A-Za-z0-9+/]++={{0,2}}\s*+\Z"
_PRIVATE_KEY = (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
                rf"(?:{_NO_DASHES}-{{5,}}+END [A-Z ]{{0,20}}PRIVATE KEY-{{0,5}}+|{_KEY_HEADERS}(?:{_KEY_BODY}))?+")

# Further published key formats.
EXTRA = (
    Rule("private_key", _PRIVATE_KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"bearer\x20[A-Za-z0-9._~+/-]{20,}=*", any_case=True),
)
RULES = BASE + EXTRA


# -- Boolean trigram queries -------------------------------------------------
# A query is True (all texts), a trigram, ("and", frozenset) or ("or", frozenset).

def _all(parts):
    out = set()
    for q in parts:
        if q is True:
            continue
        out |= q[1] if isinstance(q, tuple) and q[0] == "and" else {q}
    return True if not out else next(iter(out)) if len(out) == 1 else ("and", frozenset(out))


def _any(parts):
    out = set()
    for q in parts:
        if q is True:
            return True
        out |= q[1] if isinstance(q, tuple) and q[0] == "or" else {q}
    return next(iter(out)) if len(out) == 1 else ("or", frozenset(out))


def _grams(s: str):
    return _all(s[i:i + 3] for i in range(len(s) - 2))


_MOST = 64  # strings of a node that are kept exactly; beyond, trigrams so far are mandatory


def _walk(tree) -> list[tuple[set[str] | None, object]]:
    """Per element of a sequence: (its exact strings, or None; its query)."""
    for op, arg in tree:
        if op is C.LITERAL:
            yield {chr(arg)}, True
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 8:
            yield {chr(a) for _, a in arg}, True
        elif op is C.SUBPATTERN:
            yield from _walk(arg[3])
        elif op is C.BRANCH:
            both = [_sequence(x) for x in arg[1]]
            if all(e is not None for e, _ in both) and sum(len(e) for e, _ in both) <= _MOST:
                yield set().union(*(e for e, _ in both)), True
            else:
                yield None, _any(q for _, q in both)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, sub = arg
            exact, query = _sequence(sub)
            if exact is not None and high == 1:
                yield (exact | {""} if low == 0 else exact), True
            elif exact is not None and low == high and len(exact) ** low <= _MOST:
                for _ in range(low):
                    yield exact, True
            else:
                if low and exact is not None and len(exact) == 1:
                    yield {next(iter(exact)) * low}, True
                yield None, (query if low else True)
        elif op is C.AT or op is C.ASSERT_NOT:
            yield {""}, True
        else:  # any other element: matches anything, as far as the index knows
            yield None, True


def _sequence(tree):
    """(exact strings or None, mandatory trigram query) of a sequence."""
    exact, run, queries = True, {""}, []

    def close():
        if run != {""}:
            queries.append(_any(_grams(s) for s in run))

    for strings, query in _walk(tree):
        if strings is None:
            close()
            queries.append(query)
            exact, run = False, {""}
        elif len(run) * len(strings) > _MOST:
            close()
            exact, run = False, set(strings)
        else:
            run = {a + b for a in run for b in strings}
    if exact:
        return run, _any(_grams(s) for s in run)
    close()
    return None, _all(queries)


def trigram_query(pattern: str, any_case: bool = False):
    """The Boolean query that each text matching ``pattern`` satisfies; the
    index folds A-Z to a-z, so queries do too."""
    def fold(q):
        if q is True:
            return q
        if isinstance(q, str):
            return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in q)
        return (_all if q[0] == "and" else _any)(fold(x) for x in q[1])

    def plain(q):
        return q is True or (q.isascii() if isinstance(q, str) else all(map(plain, q[1])))

    q = fold(_sequence(P.parse(pattern, re.A | (re.I if any_case else 0)))[1])
    return q if plain(q) else True


def trigrams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


class BlockIndex:
    """Postings of a block of texts for the given trigrams."""

    def __init__(self, col: pa.Array, grams: list[str]):
        data, offsets = T.byte_view(col)
        self.n = len(offsets) - 1
        d = T.lower_ascii(data).astype(np.uint32)
        code = (d[:-2] << 16) | (d[1:-1] << 8) | d[2:] if len(d) > 2 else np.zeros(0, np.uint32)
        want = np.sort(np.array([int.from_bytes(g.encode(), "big") for g in grams], dtype=np.uint32))
        # a first filter on the low byte pair keeps the search small
        low = np.zeros(1 << 16, bool)
        low[want & 0xFFFF] = True
        at = np.flatnonzero(low[code & 0xFFFF]) if len(want) else np.zeros(0, np.int64)
        at = at[np.isin(code[at], want)]
        doc = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[doc + 1] if len(at) else np.zeros(0, bool)
        at, doc = at[inside], doc[inside]
        self.postings = {g: np.unique(doc[code[at] == int.from_bytes(g.encode(), "big")]) for g in grams}

    def search(self, query) -> np.ndarray:
        """Texts that satisfy the query, as sorted row numbers."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings[query]
        lists = sorted((self.search(q) for q in query[1]), key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


class Scanner:
    """Rules compiled with their queries."""

    def __init__(self, rules=RULES):
        self.rules = [(r, _compiled(r), trigram_query(r.pattern, r.any_case)) for r in rules]
        self.grams = sorted(set().union(*(trigrams_of(q) for _, _, q in self.rules)))

    def scan(self, col: pa.Array) -> list[list[tuple[str, int, int, int, int]]]:
        """Per text: (kind, start, end, start and end of what redaction
        replaces), sorted by start, then by the rules' order."""
        index = BlockIndex(col, self.grams)
        found: dict[int, list] = {}
        for order, (rule, rx, query) in enumerate(self.rules):
            for i in index.search(query):
                text = col[int(i)].as_py()
                for m in rx.finditer(text) if text else ():
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found.setdefault(int(i), []).append((m.start(), order, rule.kind, m.end(), *m.span(rule.replaced)))
        return [[(k, s, e, a, b) for s, _, k, e, a, b in sorted(found.get(i, ()))] for i in range(len(col))]


def _compiled(rule: Rule):
    """A run of one class with a least length is searched as that run; this
    finds the same matches as matching all runs and dropping short ones."""
    pattern = rule.pattern
    if rule.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", pattern):
        pattern = f"(?<!{pattern[:-1]}){pattern[:-1]}{{{rule.least},}}+"
    return re.compile(pattern, re.A | (re.I if rule.any_case else 0))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


def scan_documents(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = [r.kind for r in BASE]

    def task(batches):
        scanner = Scanner(rules)
        for b in T.pieces(batches, "text"):
            found = scanner.scan(b.column("text"))
            own = [[x for x in f if x[0] in base] for f in found]
            yield T.batch(["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"], [
                b.column("doc_id"),
                *(pa.array([sum(x[0] == k for x in f) for f in own], pa.int64()) for k in base),
                pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in own], pa.string()),
                pa.array(list(map(joined, found)), pa.string())])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(task, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in base) + ", base_sha256 string, spans string")


def redact(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """The documents with each secret replaced by ``[kind]``; all columns stay
    (``n_chars``, where present, is counted anew).  Overlapping secrets are
    replaced together, under the first one's kind."""
    cols = docs.columns

    def task(batches):
        scanner = Scanner(rules)
        for b in T.pieces(batches, text_col):
            text = b.column(text_col)
            out = text.to_pylist()
            for i, f in enumerate(scanner.scan(text)):
                if not f:
                    continue
                done, at, t = [], 0, out[i]
                for kind, _, _, s, e in sorted(f, key=lambda x: x[3:]):
                    if s >= at:
                        done += [t[at:s], f"[{kind}]"]
                    at = max(at, e)
                out[i] = "".join(done) + t[at:]
            columns = [pa.array(out, text.type) if c == text_col else b.column(c) for c in b.schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    done = docs.mapInArrow(task, docs.schema)
    if "n_chars" in cols:
        n = F.length(text_col).cast(docs.schema["n_chars"].dataType)
        done = done.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(n))
    return done.select(*cols)
