import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import divergence, stripes


def brute(rows, least=3, top=200):
    """rows: (text, lang, source); the contract, with Python's integers."""
    group, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
                 for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        group[lang or "", source or ""].update(words)
        seen[lang or ""].update(set(words))
    out = []
    for (lang, source), own in group.items():
        kept = [t for t, d in seen[lang].items() if d >= least]
        mates = {s: c for (x, s), c in group.items() if x == lang}
        whole = sum(mates.values(), Counter())

        def share(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p, q = share(own), share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        pairs = []
        for s, c in mates.items():
            if s != source:
                h = share(c)
                pairs.append((s, sum(f(p[t], h[t]) for t in kept)))
        terms = [(t, f(p[t], q[t])) for t in kept if own[t] and p[t] > q[t]]
        for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, v, i + 1) for i, (item, v) in enumerate(items[:limit])]
    return sorted(out)


def triples(df):
    return [(r.text, r.lang, r.source) for r in df.collect()]


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("least,top", [(1, 3), (2, 200), (3, 10), (1000, 5)])
def test_against_brute_force(docs, least, top):
    want = brute(triples(docs), least, top)
    assert want and got(divergence.audit(docs, least, top)) == want


def test_small_runs_and_merges(docs, monkeypatch):
    for name, x in (("_SLICE", 400), ("_MERGE", 64), ("_PAIRS", 7), ("_BLOCK", 5)):
        monkeypatch.setattr(divergence, name, x)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert got(divergence.audit(docs, 1, 4)) == brute(triples(docs), 1, 4)
    finally:
        docs.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_groups_without_terms(spark):
    df = spark.createDataFrame([("1 2 3", "xx", "a"), (None, "xx", "b"), ("w w w", "yy", "a"), ("", "yy", None), ("W", "yy", "a"), ("w", "yy", "c")],
                               "text string, lang string, source string")
    want = brute(triples(df))
    assert ("xx", "a", "pair", "b", 0, 1) in want and any(r[:3] == ("yy", "", "pair") for r in want)
    assert got(divergence.audit(df)) == want


def test_skyband_keeps_what_can_rank():
    rng = np.random.default_rng(3)
    for n, k in ((1, 1), (400, 1), (700, 5), (1500, 20)):
        c, total, place = rng.integers(1, 12, n), rng.integers(1, 30, n), rng.permutation(n)
        dom = (c[None, :] >= c[:, None]) & (total[None, :] <= total[:, None]) & (place[None, :] < place[:, None])
        assert sorted(divergence.skyband(c, total, place, k)) == np.flatnonzero(dom.sum(axis=1) < k).tolist()


def test_shares_are_exact():
    rng = np.random.default_rng(4)
    total = rng.integers(1, 1 << 52, 2000)
    count = (total * rng.random(2000)).astype(np.int64).clip(0, total - 1)
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(count, total)]


def test_rows_of_one_key_are_compacted():
    batch = divergence._count_slice(pa.record_batch({"text": ["a A"], "lang": ["l"], "source": ["s"]}))
    out = list(stripes.by_key([batch] * 50, ["h"], "sources", 32, divergence._merge_rows))
    assert sum(t.num_rows for t in out) < 10
    one = divergence._merge_rows(pa.concat_tables(out))
    assert one.column("d").to_pylist() == [50] and stripes.entries(one.column("counts"), np.int64)[0].tolist() == [100]


def test_empty_table(empty):
    assert divergence.audit(empty).collect() == []
    assert divergence.audit(empty).columns == ["lang", "source", "part", "item", "value", "rank"]
