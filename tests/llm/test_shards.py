import zlib

import numpy as np

from tessera.llm import shards


def jump(key, n):
    """The published algorithm, one key at a time."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_scalar_form():
    keys = np.concatenate([np.arange(-50, 500), np.array([2**63 - 1, -2**63, 10**15])])
    for n in (1, 2, 7, 16, 1000):
        assert shards.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]


def test_growth_moves_rows_only_into_the_new_shard():
    keys = np.arange(20000)
    for n in (4, 16):
        a, b = shards.jump_hash(keys, n), shards.jump_hash(keys, n + 1)
        assert set(b[a != b]) == {n}
        assert abs((a != b).mean() - 1 / (n + 1)) < 0.02
        assert np.bincount(a).min() > 0.85 * len(keys) / n


def test_whole_table(spark, docs):
    want = [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()),
             jump(r.doc_id or 0, 16), jump(r.doc_id or 0, 17)) for r in docs.collect()]
    out = shards.op4_jump_hash(spark, docs).collect()
    key = lambda t: tuple(-1 if x is None else x for x in t)
    assert sorted(map(key, want)) == sorted(key((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard)) for r in out)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append((r.slot, -1 if r.doc_id is None else r.doc_id))
    for rows in by.values():
        assert sorted(s for s, _ in rows) == list(range(len(rows)))
        assert [d for _, d in sorted(rows)] == sorted(d for _, d in rows)


def test_empty_table(spark, empty):
    assert shards.op4_jump_hash(spark, empty).count() == 0
