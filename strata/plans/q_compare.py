"""L07 on two computed runs: run specifications as data, executed into one tagged table of held-out predictions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grams, metrics, models, report
from ..operators.prep import FOLD_CTX
from ..session import staged
from ..sources.tables import COMFORT_SPEC
from ..spec import DEFAULT
from .catalog import register
from .q_split import placed_folds

ENV = COMFORT_SPEC.env


@dataclass(frozen=True)
class Run:
    """A run: preprocessing fitted on all rows of an environment (T08) or on each fold's training rows (T07), features, learners to average."""

    name: str
    per_fold: bool
    num_cols: tuple[str, ...] = COMFORT_SPEC.num_cols
    cat_cols: tuple[str, ...] = COMFORT_SPEC.cat_cols
    learners: tuple[str, ...] = tuple(sorted(models.LINEAR_LEARNERS))


PREDICTED = Run("Predicted_TSV", per_fold=False)
ADAPTIVE = Run("Adaptive_TSV", per_fold=True)


def contexts_of(rows: DataFrame, run: Run, n_folds: int) -> grams.Contexts:
    spec = COMFORT_SPEC.with_features(run.num_cols, run.cat_cols)
    # a fold number that no context holds out: every context is fitted on all rows
    return grams.fit(rows if run.per_fold else rows.withColumn("fold", F.lit(n_folds)), spec, n_folds)


def executed(rows: DataFrame, runs: Sequence[Run], n_folds: int = DEFAULT.folds) -> DataFrame:
    """(run, row_id, env, fold, y_true, y_pred) of every run.

    The mean of linear predictions is the prediction by the mean of their weights, so a run
    scores its rows once, whatever the number of learners.
    """
    out = []
    for run in runs:
        contexts = contexts_of(rows, run, n_folds)
        fits = grams.fits(grams.cells(rows, contexts), {n: models.LINEAR_LEARNERS[n] for n in run.learners})
        weights = fits.select("env", FOLD_CTX, F.posexplode("w").alias("pos", "v")).groupBy("env", FOLD_CTX, "pos").agg(F.avg("v").alias("v"))
        mean = weights.groupBy("env", FOLD_CTX).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("l"))
        mean = staged(mean.select("env", FOLD_CTX, F.lit(run.name).alias("name"), F.transform("l", lambda x: x.v).alias("w")), "fits")
        out.append(grams.predict(rows, contexts, mean).withColumnRenamed("model", "run"))
    return reduce(DataFrame.unionByName, out)


def compared(oof: DataFrame, a: Run, b: Run) -> DataFrame:
    """L07 of the runs' metric summaries."""
    summary = staged(metrics.regression_metrics(oof, [ENV, "run"]), "summary")
    return report.compare_pipelines(*(summary.where(F.col("run") == r.name) for r in (a, b)), names=(a.name, b.name))


@register("L07_compare_runs")
def q_compare_runs(spark, sf):
    """L07 on two computed runs of the linear learners: preprocessing on whole environments against preprocessing in folds."""
    rows = placed_folds(spark, sf)
    return compared(staged(executed(rows, [PREDICTED, ADAPTIVE]), "oof"), PREDICTED, ADAPTIVE)
