import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing as K
from tessera.llm.tokens import default_path


def verify(docs, out, window):
    """Every id lies in exactly one piece, sequences are gapless and need no
    padding, and each piece's CRC is that of the library's own ids."""
    tok = Tokenizer.from_file(default_path())
    ids, copies = {}, defaultdict(int)
    for r in docs:
        ids[r.doc_id] = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        copies[r.doc_id] += 1
    seqs, cover = defaultdict(list), defaultdict(list)
    for p in out:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and 0 < p.length <= window
        part = np.array(own[p.start:p.start + p.length], dtype="<u4")
        assert len(part) == p.length and zlib.crc32(part.tobytes()) == p.ids_crc32
        seqs[p.sequence_id].append((p.offset, p.length, p.tier, p.step_group))
        cover[p.doc_id].append((p.start, p.length))
    for i, own in ids.items():
        hits = np.zeros(len(own), int)
        for s, n in cover[i]:
            hits[s:s + n] += 1
        assert (hits == copies[i]).all()
    groups, padding = defaultdict(int), 0
    for rows in seqs.values():
        at = 0
        for o, n, _, _ in sorted(rows):
            assert o == at
            at += n
        assert at <= window and len({x[2:] for x in rows}) == 1
        padding += 0 if at & (at - 1) == 0 else window - at
        groups[rows[0][3]] += at
        assert at == rows[0][2]
    assert padding == 0
    return groups


@pytest.mark.parametrize("window", [1024, 64, 8])
def test_pieces_equal_library_ids(spark, docs, window):
    rows = docs.collect()
    groups = verify(rows, K.pack(docs, window=window, step_tokens=8 * window).collect(), window)
    assert all(v <= 8 * window for v in groups.values())


def test_given_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    groups = verify(d.collect(), K.pack(d).collect(), 1024)
    assert sorted(groups.values())[len(groups) // 2] == K.STEP_TOKENS


def test_plan_covers_gaps():
    for hist in ({}, {5: 1}, {1024: 3}, {600: 10, 3: 1}, {x: 1 for x in range(1, 1024)}, {513: 1000}):
        cut, gaps, supply = K.plan(hist)
        assert supply >= sum(gaps.values())
        assert supply == sum(x * c for x, c in hist.items() if x <= cut)


def test_empty_table(empty):
    assert K.pack(empty).count() == 0
