"""Queries H01-H07 (main model = stacked_ensemble, baselines = the other models)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tails import normal_upper_tail_sql
from ..operators import metrics, stats
from ..sources.tables import COMFORT_SQL, PREDICTIONS_SQL, comfort, predictions, with_sql
from .catalog import register
from .q_metrics import DESC_COLS

MAIN = "stacked_ensemble"
PAIRS_SQL = PREDICTIONS_SQL + f""",
m AS (SELECT environment, row_id, abs(y_true - y_pred) AS err_main FROM preds WHERE model = '{MAIN}'),
b AS (SELECT environment, row_id, model AS baseline, abs(y_true - y_pred) AS err_base FROM preds WHERE model <> '{MAIN}'),
ok AS (SELECT environment, baseline FROM (SELECT environment, baseline, count(*) nb FROM b GROUP BY ALL)
       JOIN (SELECT environment, count(*) nm FROM m GROUP BY ALL) USING (environment) WHERE nb = nm),
pairs AS (SELECT environment, baseline, row_id, err_main, err_base, err_base - err_main AS d
          FROM b JOIN ok USING (environment, baseline) JOIN m USING (environment, row_id))"""

WILCOXON_SQL = PAIRS_SQL + """,
flag AS (SELECT environment, baseline, max(abs(d)) <= 1e-8 AS allzero FROM pairs GROUP BY ALL),
nz AS (SELECT *, abs(d) AS ad FROM pairs WHERE d <> 0),
rk AS (SELECT *, CAST(rank() OVER (PARTITION BY environment, baseline ORDER BY ad) AS double)
                 + (count(*) OVER (PARTITION BY environment, baseline, ad) - 1) / 2.0 AS r FROM nz),
agg AS (SELECT environment, baseline, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0.0 END) AS w FROM rk GROUP BY ALL),
tt AS (SELECT environment, baseline, sum(CAST(t AS double) * t * t - t) AS tie_term
       FROM (SELECT environment, baseline, ad, count(*) AS t FROM nz GROUP BY ALL) GROUP BY ALL),
wz AS (SELECT f.environment, f.baseline, f.allzero, coalesce(a.n, 0) AS n, a.w, coalesce(t.tie_term, 0.0) AS tie_term,
         CASE WHEN f.allzero THEN NULL ELSE (a.w - CAST(a.n AS double) * (a.n + 1) / 4.0)
           / sqrt(CAST(a.n AS double) * (a.n + 1) * (2 * a.n + 1) / 24.0 - t.tie_term / 48.0) END AS z
       FROM flag f LEFT JOIN agg a USING (environment, baseline) LEFT JOIN tt t USING (environment, baseline)),
wx AS (SELECT *, abs(z) / sqrt(2.0) AS _x FROM wz),
wil AS (SELECT environment, baseline, n, CASE WHEN allzero THEN 0.0 ELSE w END AS wilcoxon_stat, tie_term, z,
          CASE WHEN allzero THEN 1.0 ELSE """ + normal_upper_tail_sql("z", "_x") + """ END AS p_raw FROM wx)"""


def pairs_df(spark, sf):
    return stats.paired_errors(predictions(spark, sf), MAIN)


def wilcoxon_df(spark, sf):
    return stats.wilcoxon_signed_rank(pairs_df(spark, sf))


@register("H01_paired_errors", with_sql(PAIRS_SQL) +
          "SELECT environment, baseline, row_id, round(err_main, 6) AS err_main, round(err_base, 6) AS err_base, "
          "round(d, 6) AS d FROM pairs")
def q_h01(spark, sf):
    return pairs_df(spark, sf)


@register("H02_wilcoxon_signed_rank", with_sql(WILCOXON_SQL) +
          "SELECT environment, baseline, n, round(wilcoxon_stat, 6) AS wilcoxon_stat, round(tie_term, 6) AS tie_term, "
          "round(z, 6) AS z, round(p_raw, 6) AS p_raw FROM wil", bench=True)
def q_h02(spark, sf):
    return wilcoxon_df(spark, sf)


FRIEDMAN_SQL = PREDICTIONS_SQL + """,
e AS (SELECT environment, row_id, model, abs(y_true - y_pred) AS err FROM preds),
kt AS (SELECT environment, count(DISTINCT model) AS k FROM e GROUP BY ALL),
full_blocks AS (SELECT environment, row_id FROM (SELECT environment, row_id, count(*) bs FROM e GROUP BY ALL)
                JOIN kt USING (environment) WHERE bs = k),
ef AS (SELECT e.* FROM e JOIN full_blocks USING (environment, row_id)),
r AS (SELECT *, CAST(rank() OVER (PARTITION BY environment, row_id ORDER BY err) AS double)
               + (count(*) OVER (PARTITION BY environment, row_id, err) - 1) / 2.0 AS rnk FROM ef),
ssbn AS (SELECT environment, sum(R * R) AS ssbn FROM (SELECT environment, model, sum(rnk) AS R FROM r GROUP BY ALL) GROUP BY ALL),
ties AS (SELECT environment, sum(CAST(t AS double) * (t * t - 1)) AS ties
         FROM (SELECT environment, row_id, err, count(*) t FROM ef GROUP BY ALL) GROUP BY ALL),
nb AS (SELECT environment, count(DISTINCT row_id) AS n_blocks FROM ef GROUP BY ALL),
fr AS (SELECT environment, n_blocks, k, CASE WHEN n_blocks < 2 OR k < 3 THEN NULL ELSE
          (12.0 / (CAST(k AS double) * n_blocks * (k + 1)) * ssbn - 3 * CAST(n_blocks AS double) * (k + 1))
          / (1.0 - ties / (CAST(k AS double) * (CAST(k AS double) * k - 1) * n_blocks)) END AS friedman_chi2
       FROM nb JOIN kt USING (environment) JOIN ssbn USING (environment) JOIN ties USING (environment))"""


def _errors(spark, sf):
    p = predictions(spark, sf)
    return p.select("environment", "row_id", "model", F.abs(F.col("y_true") - F.col("y_pred")).alias("err"))


@register("H03_friedman", with_sql(FRIEDMAN_SQL) +
          "SELECT environment, n_blocks, k, round(friedman_chi2, 6) AS friedman_chi2 FROM fr")
def q_h03(spark, sf):
    return stats.friedman(_errors(spark, sf))


@register("H03_friedman_p")
def q_h03p(spark, sf):
    """Friedman chi-square with its p-value (chi-square tail via pandas UDF on one row
    per environment)."""
    return stats.friedman(_errors(spark, sf), with_p=True)


@register("H04_holm_adjust", with_sql(WILCOXON_SQL) + """,
h AS (SELECT *, row_number() OVER (PARTITION BY environment ORDER BY p_raw, baseline) - 1 AS i,
             count(*) OVER (PARTITION BY environment) AS m FROM wil),
h2 AS (SELECT *, least(CAST(m - i AS double) * p_raw, 1.0) AS adj FROM h)
SELECT environment, baseline, round(p_raw, 6) AS p_raw,
       round(max(adj) OVER (PARTITION BY environment ORDER BY p_raw, baseline
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS p_holm FROM h2""")
def q_h04(spark, sf):
    return stats.holm_adjust(wilcoxon_df(spark, sf)).select("environment", "baseline", "p_raw", "p_holm")


@register("H05_holm_reference", with_sql(WILCOXON_SQL) + """,
h AS (SELECT *, 0.05 / CAST(count(*) OVER (PARTITION BY environment)
               - (row_number() OVER (PARTITION BY environment ORDER BY p_raw, baseline) - 1) AS double) AS thr FROM wil)
SELECT environment, round(coalesce(max(CASE WHEN p_raw <= thr THEN thr END), 0.0), 6) AS holm_reference
FROM h GROUP BY environment""")
def q_h05(spark, sf):
    return stats.holm_reference(wilcoxon_df(spark, sf))


_CORR = " UNION ALL ".join(
    f"SELECT environment, '{a}' AS var_a, '{b}' AS var_b, corr({a}, {b}) AS r, "
    f"count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n FROM comfort GROUP BY environment"
    for a in DESC_COLS for b in DESC_COLS)


@register("H06_pearson_t", with_sql(COMFORT_SQL) + f"""
SELECT environment, var_a, var_b, round(r, 6) AS r, n,
       round(CASE WHEN abs(r) >= 1.0 - 1e-12 THEN NULL ELSE r * sqrt(CAST(n - 2 AS double) / (1.0 - r * r)) END, 6) AS t
FROM ({_CORR})""")
def q_h06(spark, sf):
    c = metrics.correlation_matrix(comfort(spark, sf), "environment", DESC_COLS)
    return stats.pearson_tests(c, with_p=False)


@register("H06_pearson_pvalues")
def q_h06p(spark, sf):
    """Correlation r, t and two-sided p (Student t tail via pandas UDF per matrix cell)."""
    c = metrics.correlation_matrix(comfort(spark, sf), "environment", DESC_COLS)
    return stats.pearson_tests(c, with_p=True)


@register("H07_fdr_mask", with_sql(WILCOXON_SQL) + """
SELECT environment, baseline, round(p_raw, 6) AS p_raw,
       round(CAST(row_number() OVER (PARTITION BY environment ORDER BY p_raw, baseline) AS double)
             / CAST(count(*) OVER (PARTITION BY environment) AS double) * 0.05, 6) AS threshold,
       p_raw <= CAST(row_number() OVER (PARTITION BY environment ORDER BY p_raw, baseline) AS double)
             / CAST(count(*) OVER (PARTITION BY environment) AS double) * 0.05 AS significant
FROM wil""")
def q_h07(spark, sf):
    w = wilcoxon_df(spark, sf).select("environment", "baseline", F.col("p_raw"))
    return stats.fdr_mask(w, ["environment"], ["baseline"], p="p_raw").select(
        "environment", "baseline", "p_raw", "threshold", "significant")
