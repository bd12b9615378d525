"""Online linear models over a stream (ML16): every micro-batch runs a few
full-batch gradient steps starting from the current weights, then the
weights are stored per batch id in the shared folder, so a restarted query
resumes from the last committed batch instead of repeating a step."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.learn import sgd
from ..session import scratch_path
from .runner import drive


def _last_weights(spark, base: str):
    """Weights committed by the latest finished batch under ``base``, if any.
    Only a missing folder means that there are none; weights that cannot be
    read are an error, since the stream's own checkpoint would go on."""
    try:
        rows = spark.read.parquet(f"{base}/weights/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, -1
    w = rows.orderBy(F.col("batch").desc()).limit(1).collect()
    return (json.loads(w[0]["w"]), w[0]["batch"]) if w else (None, -1)


def streaming_sgd(train: DataFrame, dim: int, kind: str = "logistic", num_iter: int = 1,
                  step: float = 0.1, reg: float = 0.0, test: DataFrame | None = None,
                  state_dir: str | None = None, start: list[float] | None = None, arrivals=None):
    """Train on a streaming DataFrame of ``(label, features)``.  Returns
    ``(weights, per_batch)``: the final weights as rows ``(j, w)`` and, when
    ``test`` (a static labelled set) is given, the error rate on it after
    every batch as ``(batch, error_rate)``.  Training begins at ``start``
    (zeros if not given).

    ``state_dir`` (in the shared folder) holds the stream checkpoint and the
    weights of every committed batch; a query restarted on the same folder
    resumes from the last committed weights, and a replayed batch is not
    applied twice.  With ``arrivals`` (``runner.arrivals_by``) the query runs
    while input arrives, each arrival trained before the next."""
    spark = train.sparkSession
    base = state_dir or scratch_path(spark, "online")
    # only a caller-given folder can hold earlier batches (a fresh one is empty)
    w0, last = _last_weights(spark, base) if state_dir else (None, -1)
    state = {"w": w0 or list(start or [0.0] * dim), "last": last}

    def on_batch(bdf: DataFrame, epoch: int) -> None:
        if epoch <= state["last"]:
            return  # already applied before a restart
        b = bdf.persist()
        if b.limit(1).count():
            state["w"] = sgd(b, kind, num_iter, dim, step=step, reg=reg, w0=state["w"])
        b.unpersist()
        e = None
        if test is not None:
            wl = F.array(*[F.lit(float(v)) for v in state["w"]])
            score = F.aggregate(F.zip_with(wl, F.col("features"), lambda a, x: a * x),
                                F.lit(0.0), lambda s, x: s + x)
            pred = (score > 0).cast("double") if kind != "least_squares" else score
            e = test.agg(F.avg((pred != F.col("label")).cast("double"))).first()[0]
        spark.createDataFrame([(epoch, json.dumps(state["w"]), e)], "batch long, w string, error_rate double") \
            .write.mode("overwrite").parquet(f"{base}/weights/b{epoch:09d}")
        state["last"] = epoch

    drive(train.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{base}/chk"), arrivals)
    weights = spark.createDataFrame([(j, float(v)) for j, v in enumerate(state["w"])], "j int, w double")
    if state["last"] < 0:
        raise RuntimeError("the stream found no input")
    per_batch = spark.read.parquet(f"{base}/weights/*").filter("error_rate is not null").select("batch", "error_rate")
    return weights, per_batch
