import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import backoff, stripes
from tessera.sources.tables import load

END, START = " end", " start"


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text) + [END]


def scalar(rows):
    """The automaton with one dictionary of arcs, walked token by token."""
    pairs = Counter()
    for i, text in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            w = words(text)
            pairs.update(zip([START, *w], w))
    uni, occurs, kinds = Counter(), Counter(), Counter()
    for (h, w), c in pairs.items():
        uni[w] += c
        occurs[h] += c
        kinds[h] += 1
    n, v = sum(uni.values()), len(uni)
    root = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    arcs = {(h, w): math.log10((c + kinds[h] * root(w)) / (occurs[h] + kinds[h])) for (h, w), c in pairs.items()}
    fail = {h: math.log10(kinds[h] / (occurs[h] + kinds[h])) for h in occurs}
    out = []
    for i, text in rows:
        state, total, base = START if START in occurs else None, 0.0, 0.0
        for w in words(text):
            base += math.log10(root(w))
            if (state, w) not in arcs:
                if state is not None:  # the failure arc
                    total += fail[state]
                    state = None
                total += math.log10(root(w))
            else:
                total += arcs[state, w]
            state = w if w in occurs else None
        w = words(text)
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(uni[x] > 0 for x in w), n, round(base, 6), round(total, 6)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in df.collect()), key=repr)


def close(a, b):
    return len(a) == len(b) and all(x[:5] == y[:5] and abs(x[5] - y[5]) < 2e-6 and abs(x[6] - y[6]) < 2e-6 for x, y in zip(a, b))


@pytest.mark.parametrize("block", [1 << 20, 2000, 100])
def test_against_scalar_automaton(docs, block):
    assert close(got(backoff.score(docs, block)), scalar([(r.doc_id, r.text) for r in docs.collect()]))


def test_hot_prefixes_are_split(docs, monkeypatch):
    monkeypatch.setattr(stripes, "least_share", lambda spark: 0.02)
    assert close(got(backoff.score(docs, 3000)), scalar([(r.doc_id, r.text) for r in docs.collect()]))


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    df = spark.createDataFrame([(held, "a b a"), (None, "a"), (held, None)], "doc_id long, text string")
    assert got(backoff.score(df)) == sorted([(held, True, 4, 0, 0, 0.0, 0.0), (None, False, 2, 0, 0, 0.0, 0.0), (held, True, 1, 0, 0, 0.0, 0.0)], key=repr)


def test_probabilities_sum_to_one():
    """A state's arcs, and the root's words past its failure arc, share out 1."""
    t, learn = backoff.Tokens([]), np.ones(1)
    t.word, t.before = np.array([10, 11, 0, 12, 0]), np.array([1, 10, 11, 1, 12])
    t.check, t.size, t.doc = np.zeros(5, np.int64), np.array([5]), np.zeros(5, np.int64)
    q = backoff.Question(t, learn, {}, 1)
    a = backoff.Automaton(q, backoff.answer(pa.Table.from_batches([q.rows(0, 1)]), {}), {})
    root = 10 ** a.root
    start = np.searchsorted(q.vocab, 1)
    words = [i for i in range(len(q.vocab)) if i != start]
    assert abs(root[words].sum() + 0.5 / (a.n + 0.5 * (len(words) + 1)) - 1) < 1e-12
    for state in range(len(q.vocab)):
        seen = q.next[q.prefix == state]
        if len(seen):
            rest = 1 - root[seen].sum()
            assert abs((10 ** a.arc[q.prefix == state]).sum() + 10 ** a.fail[state] * rest - 1) < 1e-12


def test_model_beats_base_on_held_out(spark):
    rows = [r for r in backoff.score(load(spark, "/root/testdata/sf0.001", "documents")).collect() if r.held_out]
    per = [sum(getattr(r, c) for r in rows) / sum(r.n_tokens for r in rows) for c in ("base_score", "score")]
    assert per[1] > per[0] + 0.2 and all(0 < r.n_known <= r.n_tokens for r in rows)


def test_empty_table(empty):
    assert backoff.score(empty).collect() == []
