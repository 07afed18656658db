"""Queries B01-B03, B05-B08 on the out-of-fold table of the base models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, shards, split, stack
from ..session import staged
from ..sources.tables import PREDICTIONS_SQL, comfort, predictions, predictions_from, with_sql
from . import sqlgen
from .catalog import register

ENV = "environment"
BASE = ("linear_qty", "linear_disc", "blend_noisy", "constant")
PCOLS = [f"p__{m}" for m in BASE]


def base_wide(spark, sf):
    p = predictions(spark, sf).where(F.col("model").isin(*BASE))
    return stack.wide_oof(p, BASE)


def stack_folds(cf, repeats=3):
    b = staged(split.target_bins(cf).select("row_id", ENV, "bin"), "bins")
    return split.repeated_folds(b, repeats=repeats, stratum="bin").select("row_id", ENV, "rep", "fold")


def stack_inputs(spark, sf):
    """The base models' wide predictions, a row for each repeat with its fold of the stacker, written once: the sums, the boosted fits and the result all read them."""
    cf = staged(comfort(spark, sf).select("row_id", ENV, "f_qty", "f_disc", "target"), "comfort")
    wide = stack.wide_oof(predictions_from(cf).where(F.col("model").isin(*BASE)), BASE)
    return staged(wide.join(stack_folds(cf), ["row_id", ENV]), "stack")


def _cv(inputs, methods):
    return stack.stacker_cv(inputs, None, PCOLS, methods=methods)


def boosted_stack(inputs):
    """Stacked rows of the boosted-tree blender, in the form of ``stack.stacker_cv``."""
    d = (inputs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
         .withColumn("role", F.when(F.col("fold") == F.col("k"), "valid").otherwise("train")))
    out = shards.fit_predict(d, PCOLS, ["gbt_stack"], (ENV, "rep", "k"), target="y_true")
    return out.select("row_id", ENV, "rep", F.col("k").alias("fold"), F.lit("gbt").alias("method"), "y_true", F.col("y_pred").alias("y_stack"))


def _all_stackers(spark, sf):
    inputs = stack_inputs(spark, sf)
    return _cv(inputs, ("nnls", "ridge", "avg")).unionByName(boosted_stack(inputs))


@register("B01_blend_ridge")
def q_b01(spark, sf):
    """Ridge blender (z-scored columns, alpha by inner CV): stacked OOF predictions."""
    return _cv(stack_inputs(spark, sf), ("ridge",))


@register("B02_blend_nnls", bench=True)
def q_b02(spark, sf):
    """Non-negative blend, weights normalised, intercept kept: stacked OOF predictions."""
    return _cv(stack_inputs(spark, sf), ("nnls",))


@register("B03_blend_avg", with_sql(PREDICTIONS_SQL) + f"""
SELECT row_id, environment, round(({" + ".join(f"max(CASE WHEN model = '{m}' THEN y_pred END)" for m in BASE)})
       / {float(len(BASE))}::double, 6) AS y_stack
FROM preds WHERE model IN ({", ".join(f"'{m}'" for m in BASE)}) GROUP BY row_id, environment""")
def q_b03(spark, sf):
    return stack.blend_avg(base_wide(spark, sf), PCOLS).select("row_id", ENV, "y_stack")


@register("B05_evaluate_stackers")
def q_b05(spark, sf):
    return stack.evaluate_stackers(_all_stackers(spark, sf))


@register("B06_auto_select_stacker")
def q_b06(spark, sf):
    return stack.auto_select(stack.evaluate_stackers(_all_stackers(spark, sf)))


_BASE_SQL = PREDICTIONS_SQL + f""",
bp AS (SELECT * FROM preds WHERE model IN ({", ".join(f"'{m}'" for m in BASE)})),
bm AS (SELECT environment, model, {", ".join(f"{v} AS {k}" for k, v in sqlgen.reg_exprs(rnd=False).items())}
       FROM bp GROUP BY environment, model)"""


@register("B07_best_single_base", with_sql(_BASE_SQL) + f"""
SELECT environment, model, {sqlgen.r6(["RMSE", "MAE", "R2", "Accuracy", "Residual_STD", "MBE"])} FROM (
  SELECT *, row_number() OVER (PARTITION BY environment ORDER BY R2 DESC NULLS LAST, RMSE, model) AS r FROM bm)
WHERE r = 1""")
def q_b07(spark, sf):
    p = predictions(spark, sf).where(F.col("model").isin(*BASE))
    return stack.best_single_base(metrics.regression_metrics(p, [ENV, "model"]))


@register("B08_blend_importance")
def q_b08(spark, sf):
    fits = stack.final_blend(base_wide(spark, sf), PCOLS)
    return stack.blend_importance(fits, PCOLS, [ENV])
