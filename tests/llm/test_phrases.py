import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import phrases, stripes


def brute(rows, least, subsumed=50, top=2000):
    """rows: (text, lang); the contract, counted with dictionaries."""
    grams, total = {}, Counter()
    for text, lang in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    grams.setdefault(lang or "und", Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, f in grams.items():
        found = []
        longer = {g: a for g, a in f.items() if len(g) == 3 and a >= least}
        for g, a in f.items():
            if len(g) < 2 or a < least:
                continue
            if len(g) == 2 and any(100 * b >= subsumed * a for h, b in longer.items() if g in (h[:2], h[1:])):
                continue
            score, k = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            found.append((" ".join(g), a, f[g[:k]], f[g[k:]], total[lang], score))
        found.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(found[:top])]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("least", [1, 2, 5])
def test_phrases_against_brute_force(docs, least):
    rows = [(r.text, r.lang) for r in docs.collect()]
    want = brute(rows, least)
    assert want and got(phrases.mine(docs, least)) == want


def test_hot_prefixes_are_split(spark, docs, monkeypatch):
    texts = [("the a the b the c. The a the b a b " * 40, "en"), ("a b c " * 300, None), ("x y. z", "en")]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string")
    monkeypatch.setattr(stripes, "least_share", lambda spark: 0.01)
    rows = phrases.merged(df, 1).filter("kind = 1").groupBy("lang", "word").count().collect()
    assert max(r["count"] for r in rows) > 1  # several shards of one prefix
    assert got(phrases.mine(df, 2)) == brute(texts, 2)
    assert got(phrases.mine(docs, 2)) == brute([(r.text, r.lang) for r in docs.collect()], 2)


def test_batches_of_one_key_and_top(docs, monkeypatch):
    monkeypatch.setattr(phrases, "_MERGE", 64)
    monkeypatch.setattr(phrases, "_CHUNK", 50)
    monkeypatch.setattr(stripes, "TOKENS", 100)
    assert got(phrases.mine(docs, 2, top=3)) == brute([(r.text, r.lang) for r in docs.collect()], 2, top=3)


def test_products_pass_64_bits(spark):
    big = 10**12 + 7
    df = spark.createDataFrame([(big, big + 3, 3 * big)], "a long, x long, y long")
    assert df.select(phrases._score(F.col("a"), F.col("x"), F.col("y"))).first()[0] == 1000000 * big * big // ((big + 3) * 3 * big)


def test_empty_table(empty):
    assert phrases.mine(empty).collect() == []
    assert phrases.mine(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_same_hash_is_an_error(spark, monkeypatch):
    df = spark.createDataFrame([(1, "aa aa", "en"), (2, "bb bb", "en")], "doc_id long, text string, lang string").repartition(2, "doc_id")
    monkeypatch.setattr(phrases.T, "run_hashes", lambda data, s, e: (e - s).astype("uint64"))
    with pytest.raises(Exception, match="same 64-bit hash"):
        phrases.mine(df, 1).collect()
