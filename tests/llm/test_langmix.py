import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import langmix as L

SF = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet(SF))


def test_trigram_sums_equal_loop():
    texts = ["Ab cd", "", "x1 22 éa  Z", " \n", "end"]
    g = L.Grams(pa.array(texts))
    table = np.random.default_rng(1).random(L.BUCKETS)
    want = []
    for t in texts:
        for w in t.split():
            raw = w.encode().lower()
            if any(b >= 128 or chr(b).isalpha() for b in raw):
                p = b" " + raw + b" "
                codes = [int.from_bytes(p[i:i + 3], "big") for i in range(len(raw))]
                want.append(sum(table[(c * 0x9E3779B1 & 0xFFFFFFFF) >> 16] for c in codes))
    assert np.allclose(g.word_scores(table), want)
    assert len(g.positions()) == sum(g.end - g.start)


def test_counts_equal_loop(spark, docs):
    m = L.fit(docs)
    rows = [r for r in docs.collect() if r.doc_id is not None and r.lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    assert m.langs == sorted({r.lang for r in rows})
    counts = np.zeros(L.BUCKETS)
    for r in rows:
        g = L.Grams(pa.array([r.text]))
        counts += np.bincount(g.bucket[g.positions()], minlength=L.BUCKETS)
    smooth = counts + L.SMOOTHING
    assert np.allclose(m.logp[0], np.log(smooth / smooth.sum()))


def test_held_out_accuracy(spark, model):
    d = spark.read.parquet(SF)
    got = L.predict(d, model).join(d.select("doc_id", "lang"), "doc_id").filter("held_out")
    acc, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and acc > 0.97


def test_mixtures_get_their_shares(spark, model):
    rows = {r.lang: r.text for r in spark.read.parquet(SF).filter("n_chars > 3000").collect()}
    half = lambda t, n: " ".join(t.split()[:n])
    names, score = model.predict(pa.array([half(rows["en"], 150) + " " + half(rows["de"], 50), half(rows["fr"], 200)]))
    assert names == ["en", "fr"] and 0.65 < score[0] < 0.85 and score[1] > 0.9


def test_edge_cases(spark, docs, empty, model):
    out = {r.doc_id: r for r in L.predict(docs, model).collect()}
    for r in docs.collect():
        o = out[r.doc_id]
        assert (o.lang_pred == "und") == (not r.text or not any(map(str.isalpha, r.text)))
        assert 0 <= o.score <= 1 and o.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert L.predict(empty, model).count() == 0
    none = L.fit(empty)
    assert none.langs == [] and {r.lang_pred for r in L.predict(docs, none).collect()} == {"und"}
    kept = L.filter_known(spark.read.parquet(SF))
    assert kept.columns == spark.read.parquet(SF).columns and kept.count() > 900


def test_long_unknown_script_is_rejected(spark, model):
    names, score = model.predict(pa.array(["русский текст " * 5000, "漢字かな交じり文 " * 30]))
    assert (score < 0.5).all()


def test_mixtures_of_known_languages_are_kept(spark):
    """Even mixes stay; text that no learned language explains goes."""
    d = spark.read.parquet(SF)
    text = {r.lang: r.text.split()[:120] for r in d.filter("n_chars > 3000").collect()}
    langs = sorted(text)
    mix = lambda names: " ".join(w for x in names for w in text[x])
    more = [(-1, mix(langs[:2])), (-2, mix(langs[:3])), (-3, "русский текст " * 200),
            (-4, mix(langs[:2]) + " q7 zz9x" * 20), (-5, mix(langs[:1]) + " русский текст" * 180)]
    assert len(langs) >= 3
    rows = spark.createDataFrame([(i, t, None) for i, t in more], "doc_id long, text string, lang string")
    kept = L.filter_known(d.select("doc_id", "text", "lang").union(rows)).filter("doc_id < 0").collect()
    assert sorted(r.doc_id for r in kept) == [-4, -2, -1]


def scalar(model, text):
    """Mixture inference of one text, word by word: EM over lists of numbers,
    all sets in the order of the shares, thousands of steps."""
    g = L.Grams(pa.array([text]))
    k = len(model.langs)
    logs = [[float(g.word_scores(model.logp[i])[w]) for i in range(k)] + [model.other * float(g.end[w] - g.start[w])] for w in range(len(g.start))]

    def em(allowed):
        share = {j: 1 / len(allowed) for j in allowed}
        like = [{j: math.exp(row[j] - max(row)) for j in allowed} for row in logs]
        for _ in range(3000):
            new = dict.fromkeys(allowed, 0.0)
            for w in like:
                total = max(sum(share[j] * w[j] for j in allowed), 1e-300)
                for j in allowed:
                    new[j] += share[j] * w[j] / total / len(like)
            moved, share = max(abs(new[j] - share[j]) for j in allowed), new
            if moved < 1e-9:
                break
        return share, sum(math.log(max(sum(share[j] * w[j] for j in allowed), 1e-300)) for w in like)

    first, _ = em([*range(k), k])
    order = sorted(range(k), key=lambda j: (-round(first[j], 5), j))
    best, out = -math.inf, None
    for size in range(1, k + 1):
        share, fit = em([*order[:size], k])
        worth = fit - L.PENALTY * size * math.log(len(logs) + 1)
        if worth <= best:
            break
        best, out = worth, share
    pick = max((j for j in out if j < k), key=lambda j: (out[j], -j))
    return model.langs[pick], out[pick]


def test_mixtures_equal_scalar_inference(spark, model):
    rows = spark.read.parquet(SF).filter("n_chars between 60 and 1500").orderBy("doc_id").limit(60).collect()
    half = lambda t: " ".join(t.split()[:40])
    texts = [r.text for r in rows[:40]] + [half(a.text) + " " + half(b.text) for a, b in zip(rows[40:50], rows[50:])]
    names, score = model.predict(pa.array(texts))
    for text, name, s in zip(texts, names, score):
        want, share = scalar(model, text)
        assert abs(share - s) < 2e-3 and (name == want or abs(share - s) < 1e-4), (text, name, want, s, share)


def test_without_a_learned_language_nothing_is_dropped(spark, docs):
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert L.filter_known(unlabelled).count() == docs.count()
    held = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    assert held.count() and L.filter_known(held).count() == held.count()


def test_filter_known_with_other_column_names(spark):
    d = spark.read.parquet(SF).select(F.col("doc_id").alias("i"), F.col("text").alias("body"), F.col("lang").alias("l"))
    more = spark.createDataFrame([(-1, None, "en"), (-2, "12 34 !", "en")], "i long, body string, l string")
    kept = L.filter_known(d.union(more), id_col="i", text_col="body", lang_col="l")
    assert kept.columns == ["i", "body", "l"] and kept.count() > 900 and kept.filter("i < 0").count() == 0


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        L.fit(spark.read.parquet(SF))
