import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import quality as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    many = Counter(grams)
    hit = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
            len(text), len(lines), len(set(w)), sum(c in "0123456789" for c in text), sum("A" <= c <= "Z" for c in text))


def test_statistics_equal_brute_force(docs):
    want = sorted((r.doc_id if r.doc_id is not None else -1, *brute(r.text)) for r in docs.collect())
    got = sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in Q.text_stats(docs).collect())
    assert got == want


def test_list_is_learned_and_spark_form_agrees(spark, docs):
    rng = np.random.default_rng(3)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = (x["a"] > 0.8) | ((x["b"] <= 0.2) & (x["c"] > 0.5))
    rules = Q.learn_list(x, bad, np.arange(3000) % 3 != 0)
    fresh = {k: rng.random(2000) for k in x}
    truth = (fresh["a"] > 0.8) | ((fresh["b"] <= 0.2) & (fresh["c"] > 0.5))
    assert (~rules.keep(fresh) == truth).mean() > 0.95
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(*fresh.values())], "a double, b double, c double")
    got = [r[0] for r in df.select(rules.keep_expr({k: F.col(k) for k in x})).collect()]
    assert got == rules.keep(fresh).tolist()


def test_no_labels_leave_the_base_rule(spark, docs, empty):
    stats = Q.text_stats(docs)
    rules = Q.fit_list(stats, spark.createDataFrame([], "doc_id long, quality int"))
    assert rules.rules == []
    out = Q.judge(stats, rules).collect()
    assert all(r.kept == (not r.base_failed) for r in out)
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert Q.judge(Q.text_stats(empty), rules).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf):
    """Learned on two thirds of the labels, judged on the rest."""
    from pyspark.sql import functions as F
    stats = Q.text_stats(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("_held", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0)
    rules = Q.fit_list(stats, labels.filter("not _held"))
    assert rules.rules
    r = (Q.judge(stats, rules).join(labels.filter("_held"), "doc_id")
         .agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.count("*"),
              F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int")))).first())
    assert r[0] > 0.9 and r[2] > 0.9
