from support import rows
from tessera.operators.prep import labeled_points
from tessera.plans import reference_workloads as W


def test_points_survive_their_text(spark):
    """The points that training parses are the generated ones, to the last bit."""
    d = W._data(spark, 500, 4, "svm", 3)
    flat = lambda x: sorted((r.label, *r.features) for r in x.collect())
    assert flat(d) == flat(labeled_points(spark, 500, 4, kind="svm", parts=3)) and len(rows(d.select("label"))) == 500
    assert d.storageLevel.useMemory and "FileScan text" in d._jdf.queryExecution().executedPlan().toString()
    d.unpersist()
