import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import imatch as I

SF = "/root/testdata/sf0.01/documents.parquet"


def words(t):
    return {w for w in (t or "").encode().lower().split()}


def test_lexicon_equals_brute_force(spark, docs):
    rows = [r.text for r in docs.collect()]
    df = {}
    for t in rows:
        for w in words(t):
            df[w] = df.get(w, 0) + 1
    want = sorted(w for w, c in df.items() if 0.03 * len(rows) <= c <= 0.6 * len(rows))
    got = I.lexicon(docs, 0.03, 0.6)
    h = np.unique(I.T.Words(pa.array([b" ".join(want).decode()]), lower=True).shingles(1)[1])
    assert len(want) > 5 and np.array_equal(got, h)


mask = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & mask
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & mask
    return x ^ (x >> 31)


def brute_signature(terms, k):
    """Signature of a set of terms in sub-lexicon k, one term at a time."""
    seed = mix((k + 1) * 0x9E3779B97F4A7C15 & mask)
    inside = [mix(t ^ seed) for t in sorted(terms)]
    inside = [h for h in inside if h < (1 << 64) // I._RATES[k * 3 // I.SUBSETS]]
    return max(mix(sum(map(mix, inside)) & mask) >> 32, 1) if inside else 0


@pytest.mark.parametrize("table", ["edge", "given"])
def test_query_equals_brute_force(spark, docs, table):
    d = docs if table == "edge" else spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    band = set(I.lexicon(d).tolist())
    rows = sorted(((r.doc_id, r.text or "") for r in d.collect()), key=lambda x: (x[0] is None, -(x[0] or 0)))
    hashes = {}

    def sig(t):
        ws = sorted(words(t))
        terms = set(I.T.Words(pa.array([t]), lower=True).shingles(1)[1].tolist())
        assert len(terms) == len(ws)
        used = {x for x in terms if x in band} or terms
        out = [brute_signature(used, k) for k in range(I.SUBSETS)]
        if used and not any(out):
            out[0] = max(mix(sum(map(mix, used)) & mask) >> 32, 1)
        return hashes.setdefault(t, out)

    def like(a, b):
        either = [x or y for x, y in zip(a, b)]
        return sum(x == y and x > 0 for x, y in zip(a, b)) / sum(map(bool, either)) if any(either) else 1.0

    text = lambda s: "".join(f"{x:08x}" for x in s)
    want = []
    for i, (doc, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        k = len(t) // 3
        ed = t[:len(t) - k] + nxt[:k]
        want.append((str(doc), len(t), hashlib.sha256(ed.encode()).hexdigest(), text(sig(t)), text(sig(ed)),
                     round(like(sig(t), sig(ed)), 9), round(like(sig(t), sig(nxt)), 9)))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
           for r in I.compare_with_next(d).collect()]
    assert sorted(got) == sorted(want)


def test_edits_stay_closer_than_strangers(spark):
    out = I.compare_with_next(spark.read.parquet(SF)).toPandas()
    assert len(out) == 1000
    assert (out.near_edited > out.near_next).mean() > 0.85 and out.near_next.mean() < 0.1 and out.near_edited.mean() > 0.15


def test_single_and_empty_table(spark, empty):
    one = I.compare_with_next(spark.createDataFrame([(1, "a few words")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0
    assert I.compare_with_next(empty).count() == 0
