"""Composite runs: M16, B09, B10, L06, L09 (rows checks)."""

from __future__ import annotations

from ..sources.tables import COMFORT_SQL, with_sql
from . import loeo, sqlgen, variants
from .catalog import register
from .q_models import XT_SQL
from .q_split import FOLDS_SQL, KS_SQL


@register("M16_baseline_run")
def q_m16(spark, sf):
    """Selection pass + retrain pass + calibration for every linear baseline."""
    return variants.baseline_run(spark, sf)


@register("B09_stacker_sweep")
def q_b09(spark, sf):
    return variants.stacker_sweep(spark, sf)


@register("B10_loeo_stack")
def q_b10(spark, sf):
    return loeo.loeo_stack(spark, sf)


@register("L06_loeo_metrics")
def q_l06(spark, sf):
    return loeo.loeo_metrics(spark, sf)


LOEO_SQL = XT_SQL.replace(FOLDS_SQL, COMFORT_SQL + """,
folds AS (SELECT * REPLACE ('pooled' AS environment), CAST(dense_rank() OVER (ORDER BY environment) - 1 AS INTEGER) AS fold, environment AS test_env FROM comfort)""").replace(
    KS_SQL, "ks AS (SELECT DISTINCT fold AS k FROM folds)")


@register("L06_loeo_metrics_single", with_sql(LOEO_SQL) + f""",
held AS (SELECT f.test_env AS "TestEnv", o.model AS "Model", o.y_true, o.y_pred FROM oof o JOIN folds f USING (row_id)),
per AS ({sqlgen.reg_select('"TestEnv", "Model"', "held")}),
raw AS (SELECT "TestEnv", "Model", {", ".join(f"{v} AS {k}" for k, v in sqlgen.reg_exprs(rnd=False).items())} FROM held GROUP BY ALL)
SELECT "TestEnv", "Model", RMSE, MAE, R2, Accuracy FROM per
UNION ALL SELECT '*mean*', "Model", {", ".join(f"round(avg({c}), 6)" for c in loeo.LOEO_METRICS)} FROM raw GROUP BY "Model" """)
def q_l06_single(spark, sf):
    """Leave-one-environment-out of one OLS model per numeric feature."""
    return loeo.loeo_single(spark, sf)


@register("L09_ablation_grid")
def q_l09(spark, sf):
    """4 selection modes x 2 scopes x stack on/off x calibration on/off x 3 k = 96 variants."""
    return variants.ablation_grid(spark, sf)
