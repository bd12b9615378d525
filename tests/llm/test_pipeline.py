import re

import corpus_pipeline as C
from test_jaccard import brute as components
from test_packing import verify
from test_quality import brute as stats
from tessera.llm import quality, secrets

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in C.STAGES:
        out = C.cut_to_table(stage(spark, docs, SF))
        got = out.collect()
        if name == "packing":
            verify(list(rows.values()), got, 1024)
            break
        assert out.columns == cols and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        now = {r.doc_id: r for r in got}
        assert len(now) == len(got) and now.keys() <= rows.keys()
        if name == "language":
            assert all(now[i] == rows[i] for i in now) and len(now) > 0.95 * len(rows)
        if name == "quality":
            for i, r in rows.items():
                s = dict(zip(quality.COUNTS, stats(r.text)))
                if s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"]:
                    assert i not in now
            good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()} & rows.keys()
            assert len(good & now.keys()) > 0.9 * len(good)
        if name == "near_duplicates":
            want = components([(i, r.text) for i, r in rows.items()], 5, 80)
            assert sorted(now) == sorted(i for i, (_, c) in want.items() if c == i) and len(now) < len(rows)
        if name == "secrets":
            rx = re.compile(secrets.BASE[0].pattern, re.A | re.I)
            assert now.keys() == rows.keys()
            assert any(rx.search(r.text) for r in rows.values())
            for i, r in now.items():
                assert not any(len(m[2]) >= 8 for m in rx.finditer(r.text)) and r.n_chars == len(r.text)
                assert "[assign]" in r.text or "[hex]" in r.text or "[access]" in r.text or r.text == rows[i].text
        docs, rows = out, now


def test_edge_cases(spark, docs, empty):
    """All stages on nulls, empty and repeated texts, and on no rows at all."""
    for d in (docs, empty):
        now = d
        for name, stage in C.STAGES:
            out = C.cut_to_table(stage(spark, now, SF))
            if name != "packing":
                assert out.columns == d.columns and out.count() <= now.count()
                now = out


def test_run(spark):
    assert C.run(spark, "/root/testdata/sf0.001").count() > 100
