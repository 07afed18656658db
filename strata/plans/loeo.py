"""Leave-one-environment-out runs.

The pooled table is one group whose folds are the environments (K05): context k holds out
environment k.  Sums of Z' Z are kept apart by held-out environment and inner fold, and
what a fit needs is a sum or difference of these cells, so no row is copied for a held-out
environment or an inner fold: rows are scanned once for the sums and once for the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import join_stats
from ..operators import grams, metrics, models
from ..operators.prep import FOLD_CTX
from ..session import staged
from ..sources.tables import COMFORT_SPEC, comfort_rows
from .q_models import SINGLE

ENV = "environment"
POOL = "pooled"
LEARNERS = models.LINEAR_LEARNERS
# LOEO ranking direction per metric (True = lower is better).
LOEO_METRICS = {"RMSE": True, "MAE": True, "R2": False, "Accuracy": False}


def pooled(spark, sf) -> tuple[DataFrame, DataFrame, int]:
    """(all rows as one group with fold = number of their environment, (test_env, k), number of environments)."""
    cf = comfort_rows(spark, sf)
    names = sorted(r[0] for r in cf.select(ENV).distinct().collect())  # the groups that are left out in turn: a handful
    idx = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "test_env string, fold int")
    rows = join_stats(cf.withColumnRenamed(ENV, "test_env"), idx, ["test_env"]).withColumn(ENV, F.lit(POOL))
    return rows, idx.withColumnRenamed("fold", FOLD_CTX), len(names)


def _ranked(scored: DataFrame, idx: DataFrame) -> DataFrame:
    per = scored.join(F.broadcast(idx), FOLD_CTX).select(F.col("test_env").alias("TestEnv"), F.col("name").alias("Model"), *LOEO_METRICS)
    mean = per.groupBy("Model").agg(*[F.avg(m).alias(m) for m in LOEO_METRICS]).withColumn("TestEnv", F.lit("*mean*"))
    best = [F.col(m).asc() if lower else F.col(m).desc() for m, lower in LOEO_METRICS.items()]
    return per.unionByName(mean).orderBy("TestEnv", *best, "Model")


def loeo_metrics(spark, sf, learners=LEARNERS, categorical: bool = True) -> DataFrame:
    """All linear learners trained on the other environments, scored on the held-out one;
    plus the mean over held-out environments per model (TestEnv = '*mean*'), best first."""
    rows, idx, n = pooled(spark, sf)
    contexts = grams.fit(rows, COMFORT_SPEC, n, categorical=categorical)
    fits = staged(grams.fits(grams.cells(rows, contexts), learners), "fits")
    return _ranked(staged(grams.score(rows, contexts, fits, by_fold=True), "loeo"), idx)


def loeo_single(spark, sf) -> DataFrame:
    """L06 with one OLS model per numeric feature, the form that SQL can check."""
    return loeo_metrics(spark, sf, SINGLE, categorical=False)


def _meta(names: list[str], learners: dict):
    """Per held-out environment: the OLS meta model on inner held-out predictions, folded into one predictor.

    The inner training sums of fold j are the context's training sums without cell j; the sums
    of the inner predictions are those of cell j seen through its fits.
    """
    schema = pa.schema([("env", pa.string()), ("k", pa.int32()), ("name", pa.string()), ("w", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                inner = [grams.square(c["g"]) for c in sorted(r["cells"], key=lambda c: c["cell"])]
                whole = sum(inner)
                fit = lambda g: np.column_stack([grams.solve(g, **learners[m]) for m in names])
                p = sum(grams.predictions_gram(g, fit(whole - g)) for g in inner)
                meta = grams.solve(p, "ols")
                w = fit(whole) @ meta[1:]
                w[0] += meta[0]
                out.append({"env": r["env"], "k": r["k"], "name": "stacked_ensemble", "w": w})
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    return run


def loeo_stack(spark, sf, inner_folds: int = 5, seed: int = 42, learners=LEARNERS) -> DataFrame:
    """For each held-out environment, the learners' inner out-of-fold predictions on the
    training environments feed an OLS meta model; learners refitted on all training rows
    predict the held-out rows, the meta model combines them."""
    rows, idx, n = pooled(spark, sf)
    contexts = grams.fit(rows, COMFORT_SPEC, n)
    inner = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|inner|"), F.col("row_id").cast("string"))), 1, 8), 16, 10).cast("long") % inner_folds
    cells = grams.cells(rows, contexts, cell=inner).where(f"side = {grams.TRAIN}")
    packed = cells.groupBy("env", "k").agg(F.collect_list(F.struct("cell", "g")).alias("cells"))  # inner folds x p^2 numbers
    found = staged(packed.mapInArrow(_meta(sorted(learners), learners), "env string, k int, name string, w array<double>"), "meta")
    out = grams.predict(rows, contexts, found).drop(ENV)
    return out.join(F.broadcast(idx.withColumnRenamed(FOLD_CTX, "fold")), "fold").select("row_id", "test_env", "model", "y_true", "y_pred")
