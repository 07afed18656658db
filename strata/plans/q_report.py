"""Queries L01-L05, L07, L08, L10 (leaderboards and summaries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, report
from ..sources.tables import COMFORT_SQL, PREDICTIONS_SQL, comfort, predictions, preds_sql, with_sql
from . import sqlgen
from .catalog import register
from .q_metrics import FOLD_AVG_SQL, KEYS, KS, _fold_preds

ALL = list(metrics.REG_METRICS) + list(metrics.ORD_METRICS)
STACK = "stacked_ensemble"
EV_SQL = PREDICTIONS_SQL + "," + sqlgen.eval_ctes(KS, "preds", "ev")


def leaderboard(spark, sf):
    """Metric row per (environment, model) -- the leaderboard input."""
    return metrics.evaluate(predictions(spark, sf), KEYS)


@register("L01_combine_results", with_sql(FOLD_AVG_SQL + ",\n" + preds_sql() + "," + sqlgen.eval_ctes(KS, "preds", "ev"))
          + f"""
SELECT {KS}, {sqlgen.r6(ALL)}, NULL::double AS Train_Accuracy FROM ev WHERE model = '{STACK}'
UNION ALL
SELECT ev.environment, ev.model, {", ".join(f"round(ev.{c}, 6) AS {c}" for c in ALL)}, round(f.Train_Accuracy, 6)
FROM ev JOIN favg f USING ({KS}) WHERE ev.model <> '{STACK}'""")
def q_l01(spark, sf):
    ev = leaderboard(spark, sf)
    stack = ev.where(F.col("model") == STACK)
    train = metrics.fold_average(_fold_preds(spark, sf), KEYS).select(*KEYS, "Train_Accuracy")
    base = ev.where(F.col("model") != STACK).join(train, KEYS)
    return report.combine_results(stack, base)


RANK_SQL = EV_SQL + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY environment ORDER BY R2 DESC NULLS LAST,
           RMSE ASC NULLS LAST, MAE ASC NULLS LAST, model) AS Rank FROM ev)"""


@register("L02_rank_models", with_sql(RANK_SQL) + f"SELECT {KS}, {sqlgen.r6(ALL)}, Rank FROM ranked", bench=True)
def q_l02(spark, sf):
    return report.rank_models(leaderboard(spark, sf))


@register("L03_env_winners", with_sql(RANK_SQL) + f"SELECT {KS}, {sqlgen.r6(ALL)}, Rank FROM ranked WHERE Rank = 1")
def q_l03(spark, sf):
    return report.env_winners(report.rank_models(leaderboard(spark, sf)))


_L04_LONG = " UNION ALL ".join(
    f"SELECT environment, model, '{m}' AS metric, CAST({m} AS double) AS value, {str(low).lower()} AS lower_better FROM ev"
    for m, low in report.RANK_METRICS.items())


@register("L04_rank_by_metric", with_sql(EV_SQL) + f""",
long AS ({_L04_LONG})
SELECT environment, model, metric, round(value, 6) AS value, lower_better,
       row_number() OVER (PARTITION BY environment, metric ORDER BY
         CASE WHEN lower_better THEN value ELSE -value END ASC NULLS LAST, model) AS metric_rank
FROM long""")
def q_l04(spark, sf):
    return report.rank_by_metric(leaderboard(spark, sf))


@register("L05_average_ranks", with_sql(RANK_SQL) + """
SELECT environment, model, Rank FROM ranked
WHERE CASE WHEN (SELECT count(*) FROM ranked WHERE environment = 'building') > 0
           THEN environment = 'building'
           ELSE lower(replace(replace(environment, ' ', '_'), '/', '_')) = 'building' END""")
def q_l05(spark, sf):
    return report.average_ranks(report.rank_models(leaderboard(spark, sf)), "building")


_V01 = sqlgen.reg_exprs(rnd=False)


@register("L07_compare_pipelines", with_sql(PREDICTIONS_SQL) + f""",
a AS (SELECT environment, {", ".join(f"{v} AS {k}" for k, v in _V01.items())} FROM preds
      WHERE model = 'linear_qty' GROUP BY environment),
b AS (SELECT environment, {", ".join(f"{v} AS {k}" for k, v in _V01.items())} FROM preds
      WHERE model = 'blend_noisy' GROUP BY environment),
long AS ({" UNION ALL ".join(
    f"SELECT environment, '{m}' AS metric, a.{m} AS va, b.{m} AS vb, {str(m in report.COMPARE_LOWER_BETTER).lower()} AS lb "
    f"FROM a JOIN b USING (environment)" for m in report.COMPARE_METRICS)}),
v AS (SELECT *, vb - va AS d,
        CASE WHEN lb THEN vb - va < 0 ELSE vb - va > 0 END AS b_better,
        CASE WHEN lb THEN vb - va > 0 ELSE vb - va < 0 END AS a_better FROM long)
SELECT environment, metric, round(va, 4) AS Predicted_TSV, round(vb, 4) AS Adaptive_TSV, round(d, 4) AS difference,
  CASE WHEN b_better THEN 'Adaptive_TSV is Better' WHEN a_better THEN 'Predicted_TSV is Better' ELSE 'No change' END AS better,
  CASE WHEN sum(CAST(b_better AS INTEGER)) OVER w > sum(CAST(a_better AS INTEGER)) OVER w THEN 'Adaptive_TSV'
       WHEN sum(CAST(a_better AS INTEGER)) OVER w > sum(CAST(b_better AS INTEGER)) OVER w THEN 'Predicted_TSV'
       ELSE 'Tie' END AS overall_winner
FROM v WINDOW w AS (PARTITION BY environment)""")
def q_l07(spark, sf):
    p = predictions(spark, sf)
    a = metrics.regression_metrics(p.where(F.col("model") == "linear_qty"), ["environment"])
    b = metrics.regression_metrics(p.where(F.col("model") == "blend_noisy"), ["environment"])
    return report.compare_pipelines(a, b)


@register("L08_env_summary", with_sql(PREDICTIONS_SQL + ",\nsp AS (SELECT * FROM preds WHERE model = 'stacked_ensemble'),"
                                      + sqlgen.eval_ctes("environment", "sp", "es"))
          + f"SELECT environment, {sqlgen.r6(ALL)} FROM es")
def q_l08(spark, sf):
    p = predictions(spark, sf).where(F.col("model") == STACK)
    return metrics.evaluate(p, ["environment"])


@register("L10_pool_environments", with_sql(COMFORT_SQL) + """
SELECT row_id, 'Combined' AS environment, environment AS sub_environment, round(target, 6) AS target
FROM comfort WHERE environment IN ('AUTOMOBILE', 'BUILDING')""")
def q_l10(spark, sf):
    cf = comfort(spark, sf).select("row_id", "environment", "target")
    return report.pool_environments(cf, ["AUTOMOBILE", "BUILDING"]).select(
        "row_id", "environment", "sub_environment", "target")
