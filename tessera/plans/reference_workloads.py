"""The benchmark's machine-learning jobs at the sizes of its recorded runs
(phase ``write``); the training phase parses that text and fills the cache, as
the recorded runs do, and the test phase reads the cache.

These are measurements, not registered queries: their input is generated,
not read from the shared tables.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..operators import learn as L
from ..operators.prep import labeled_points
from ..operators.report import PhaseTimer
from ..session import scratch_path
from ..sources.text import parse_labeled_points

# Sizes and settings of the recorded reference runs, and their
LOGREG = dict(rows=2_800_000, dim=20, iters=3)
SVM = dict(rows=5_100_000, dim=10, iters=3, reg=0.01, train_fraction=0.9, seed=11)
PCA_CONF = dict(rows=800_000, dim=50, k=50)
BASELINE_MEDIAN = {
    "logreg_training": 39.984, "logreg_test": 1.815,
    "svm_training": 27.729, "svm_test": 25.030,
    "pca_training": 24.122, "pca_test": 0.962,
}


def _data(spark, rows, dim, kind, parts):
    """Labelled points as text lines in the scratch folder, and the points
    parsed from them, to be cached by whoever reads them first."""
    d = labeled_points(spark, rows, dim, kind=kind, parts=parts)
    lines = d.select(F.concat(F.lit("("), F.col("label").cast("string"), F.lit(",["),
                              F.array_join(F.col("features").cast("array<string>"), ","), F.lit("])")))
    path = scratch_path(spark, "points")
    lines.write.text(path)
    return parse_labeled_points(spark.read.text(path)).persist(StorageLevel.MEMORY_AND_DISK)


def run_all(spark, parts: int) -> dict:
    out = {}

    t = PhaseTimer()
    with t.phase("write"):
        d = _data(spark, LOGREG["rows"], LOGREG["dim"], "logistic", parts)
    with t.phase("training"):
        w = L.sgd(d, "logistic", LOGREG["iters"], LOGREG["dim"])
    with t.phase("test"):
        pred = F.when(F.lit(1.0) / (F.lit(1.0) + F.exp(-L.margin(w))) > 0.5, 1.0).otherwise(0.0)
        L.error_rate(d, pred).first()
    out.update({f"logreg_{k}": v for k, v in t.times.items()})
    d.unpersist()

    t = PhaseTimer()
    with t.phase("write"):
        d = _data(spark, SVM["rows"], SVM["dim"], "svm", parts)
        b = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(SVM["seed"])), F.lit(100))
        cached, d = d, d.withColumn("b", b)
        train = d.filter(F.col("b") < int(SVM["train_fraction"] * 100))
        test = d.filter(F.col("b") >= int(SVM["train_fraction"] * 100))
    with t.phase("training"):
        w = L.sgd(train, "hinge", SVM["iters"], SVM["dim"], reg=SVM["reg"])
    with t.phase("test"):
        L.exact_auc(test, L.margin(w), F.col("label")).first()
    out.update({f"svm_{k}": v for k, v in t.times.items()})
    cached.unpersist()

    t = PhaseTimer()
    with t.phase("write"):
        d = _data(spark, PCA_CONF["rows"], PCA_CONF["dim"], "linear", parts)
    with t.phase("training"):
        from pyspark.ml.feature import PCA
        from pyspark.ml.functions import array_to_vector
        dv = d.select(array_to_vector("features").alias("fv"))
        model = PCA(k=PCA_CONF["k"], inputCol="fv", outputCol="pv").fit(dv)
    with t.phase("test"):
        model.transform(dv).write.format("noop").mode("overwrite").save()
    out.update({f"pca_{k}": v for k, v in t.times.items()})
    d.unpersist()

    return out
