"""Queries V01-V17 and C01-C03 over the prediction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calib, metrics
from ..sources.tables import COMFORT_SPEC, PREDICTIONS_SQL, comfort, predictions, predictions_from, \
    preds_sql, with_sql
from . import sqlgen
from .catalog import register
from .q_split import FOLDS_SQL, comfort_folds

KEYS = ["environment", "model"]
KS = "environment, model"
REG = list(metrics.REG_METRICS)
ORD = list(metrics.ORD_METRICS)
P = with_sql(PREDICTIONS_SQL)


@register("V01_regression_metrics", P + sqlgen.reg_select(KS, "preds"))
def q_v01(spark, sf):
    return metrics.regression_metrics(predictions(spark, sf), KEYS)


@register("V02_tolerance_accuracy", P + f"SELECT {KS}, {sqlgen.reg_exprs()['Accuracy']} AS Accuracy "
          f"FROM preds GROUP BY {KS}")
def q_v02(spark, sf):
    return metrics.tolerance_accuracy(predictions(spark, sf), KEYS)


@register("V03_constant_safe_r2", P + f"SELECT {KS}, {sqlgen.reg_exprs()['R2']} AS R2 FROM preds GROUP BY {KS}")
def q_v03(spark, sf):
    return metrics.constant_safe_r2(predictions(spark, sf), KEYS)


def _ord_query(cols):
    return P + "," + sqlgen.ordinal_ctes(KS, "preds") + f"\nSELECT {KS}, {sqlgen.r6(cols)} FROM o_res"


def _ord(spark, sf, cols):
    return metrics.ordinal_metrics(predictions(spark, sf), KEYS).select(*KEYS, *cols)


@register("V04_exact_class_accuracy", _ord_query(["Accuracy_exact"]))
def q_v04(spark, sf):
    return _ord(spark, sf, ["Accuracy_exact"])


@register("V05_f1_macro", _ord_query(["F1_macro"]))
def q_v05(spark, sf):
    return _ord(spark, sf, ["F1_macro"])


@register("V06_cohen_kappa", _ord_query(["Kappa"]))
def q_v06(spark, sf):
    return _ord(spark, sf, ["Kappa"])


@register("V07_quadratic_kappa", _ord_query(["Kappa_quadratic"]))
def q_v07(spark, sf):
    return _ord(spark, sf, ["Kappa_quadratic"])


@register("V08_kendall_tau_b", _ord_query(["Kendall_tau_b"]))
def q_v08(spark, sf):
    return _ord(spark, sf, ["Kendall_tau_b"])


_LAB = ("CASE WHEN CAST({k} AS double) < -0.5 THEN 'Cool' WHEN CAST({k} AS double) < 0.5 "
        "THEN 'Neutral' ELSE 'Warm' END")
CONF_SQL = PREDICTIONS_SQL + f""",
lab AS (SELECT {KS}, {_LAB.format(k=sqlgen.cls('y_true'))} AS true_label,
               {_LAB.format(k=sqlgen.cls('y_pred'))} AS pred_label FROM preds),
cells AS (SELECT g.environment, g.model, t.l AS true_label, p.l AS pred_label
          FROM (SELECT DISTINCT {KS} FROM lab) g, (VALUES ('Cool'), ('Neutral'), ('Warm')) t(l),
               (VALUES ('Cool'), ('Neutral'), ('Warm')) p(l)),
cnt AS (SELECT {KS}, true_label, pred_label, count(*) AS n FROM lab GROUP BY ALL),
conf AS (SELECT c.*, coalesce(cnt.n, 0) AS count FROM cells c LEFT JOIN cnt USING ({KS}, true_label, pred_label))"""


@register("V09_confusion_matrix", with_sql(CONF_SQL) + f"""
SELECT *, round(count / CAST(greatest(sum(count) OVER (PARTITION BY {KS}, true_label), 1) AS double), 6) AS row_share
FROM conf""")
def q_v09(spark, sf):
    return metrics.confusion3(predictions(spark, sf), KEYS)


@register("V10_macro_precision_recall_f1", with_sql(CONF_SQL) + f""",
rw AS (SELECT {KS}, true_label AS c, CAST(sum(count) AS double) AS row_n FROM conf GROUP BY ALL),
cl AS (SELECT {KS}, pred_label AS c, CAST(sum(count) AS double) AS col_n FROM conf GROUP BY ALL),
tp AS (SELECT {KS}, true_label AS c, CAST(count AS double) AS tp FROM conf WHERE true_label = pred_label),
per AS (SELECT *, CASE WHEN col_n > 0 THEN tp / col_n ELSE 0.0 END AS p,
               CASE WHEN row_n > 0 THEN tp / row_n ELSE 0.0 END AS r
        FROM rw JOIN cl USING ({KS}, c) JOIN tp USING ({KS}, c) WHERE row_n + col_n > 0)
SELECT {KS}, round(avg(p), 6) AS Precision_macro, round(avg(r), 6) AS Recall_macro,
       round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END), 6) AS F1_macro
FROM per GROUP BY ALL""")
def q_v10(spark, sf):
    return metrics.macro_prf(metrics.confusion3(predictions(spark, sf), KEYS), KEYS)


FOLD_PREDS_SQL = FOLDS_SQL + ",\n" + preds_sql("folds", "fpreds", extra="fold, ")
_RE = sqlgen.reg_exprs(rnd=False)
FOLD_AVG_SQL = FOLD_PREDS_SQL + f""",
per AS (SELECT {KS}, fold, {", ".join(f"{v} AS {k}" for k, v in _RE.items())} FROM fpreds GROUP BY ALL),
fh AS (SELECT {KS}, fold, sum(CASE WHEN abs(y_true - y_pred) <= 0.5::double THEN 1.0::double ELSE 0.0::double END) AS h,
              count(*) AS c FROM fpreds GROUP BY ALL),
fh2 AS (SELECT *, (sum(h) OVER w - h) / (sum(c) OVER w - c) AS train_acc FROM fh WINDOW w AS (PARTITION BY {KS})),
favg AS (SELECT {KS}, {", ".join(f"avg({k}) AS {k}" for k in REG)}, avg(train_acc) AS Train_Accuracy
         FROM per JOIN fh2 USING ({KS}, fold) GROUP BY ALL)"""


def _fold_preds(spark, sf, folds=5):
    """Held-out predictions of every fold and those on the fold's training rows (the fixture's models are the same in every fold)."""
    p = predictions_from(comfort_folds(spark, sf), extra=("fold",)).withColumnRenamed("fold", "own")
    return (p.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
            .withColumn("role", F.when(F.col("fold") == F.col("own"), "valid").otherwise("train")).drop("own"))


@register("V11_fold_average", with_sql(FOLD_AVG_SQL) + f"SELECT {KS}, {sqlgen.r6(REG + ['Train_Accuracy'])} FROM favg")
def q_v11(spark, sf):
    return metrics.fold_average(_fold_preds(spark, sf), KEYS)


@register("V12_fit_flags", with_sql(FOLD_AVG_SQL) + f"""
SELECT {KS}, {sqlgen.r6(REG + ['Train_Accuracy'])}, Accuracy < 0.4 AS low_accuracy,
       R2 < CASE WHEN model = 'stacked_ensemble' THEN 0.3 ELSE 0.2 END AS low_r2,
       Train_Accuracy - Accuracy > 0.1 AS overfit FROM favg""")
def q_v12(spark, sf):
    return metrics.fit_flags(metrics.fold_average(_fold_preds(spark, sf), KEYS))


@register("V13_residual_by_class", P + f""",
r AS (SELECT {KS}, {sqlgen.cls('y_true')} AS true_class, y_pred - y_true AS resid FROM preds),
q AS (SELECT {KS}, true_class, quantile_cont(resid, 0.25) AS q1, quantile_cont(resid, 0.5) AS median,
             quantile_cont(resid, 0.75) AS q3 FROM r GROUP BY ALL),
w AS (SELECT {KS}, true_class, count(*) AS n,
             min(CASE WHEN resid >= q1 - 1.5 * (q3 - q1) THEN resid END) AS whisker_lo,
             max(CASE WHEN resid <= q3 + 1.5 * (q3 - q1) THEN resid END) AS whisker_hi
      FROM r JOIN q USING ({KS}, true_class) GROUP BY ALL),
grid AS (SELECT g.*, CAST(c.range AS INTEGER) AS true_class FROM (SELECT DISTINCT {KS} FROM r) g, range(-3, 4) c)
SELECT {KS}, true_class, coalesce(n, 0) AS n, {sqlgen.r6(['q1', 'median', 'q3', 'whisker_lo', 'whisker_hi'])}
FROM grid LEFT JOIN q USING ({KS}, true_class) LEFT JOIN w USING ({KS}, true_class)""")
def q_v13(spark, sf):
    return metrics.residual_by_class(predictions(spark, sf), KEYS)


@register("V14_error_histogram", P + f""",
e AS (SELECT {KS}, y_true - y_pred AS err FROM preds),
rng AS (SELECT {KS}, min(err) AS lo, max(err) AS hi, avg(err) AS mean_error,
               quantile_cont(err, 0.5) AS median_error FROM e GROUP BY ALL),
h AS (SELECT {KS}, CAST(CASE WHEN hi = lo THEN 0 ELSE least(19, floor((err - lo) / (hi - lo) * 20.0::double)) END
             AS INTEGER) AS bin, count(*) AS n FROM e JOIN rng USING ({KS}) GROUP BY ALL),
grid AS (SELECT rng.*, CAST(b.range AS INTEGER) AS bin FROM rng, range(20) b)
SELECT {KS}, bin, round(lo + bin * ((hi - lo) / 20.0::double), 6) AS bin_lo,
       round(lo + (bin + 1) * ((hi - lo) / 20.0::double), 6) AS bin_hi, coalesce(n, 0) AS n,
       round(mean_error, 6) AS mean_error, round(median_error, 6) AS median_error
FROM grid LEFT JOIN h USING ({KS}, bin)""")
def q_v14(spark, sf):
    p = predictions(spark, sf)
    return metrics.error_histogram(p, KEYS).join(metrics.error_center(p, KEYS), KEYS)


@register("V15_pred_vs_observed", P + f""",
c AS (SELECT {KS}, greatest(-3.0::double, least(3.0::double, y_true)) AS obs,
             greatest(-3.0::double, least(3.0::double, y_pred)) AS pred FROM preds
      WHERE y_true IS NOT NULL AND y_pred IS NOT NULL AND NOT isnan(y_true) AND NOT isnan(y_pred))
SELECT {KS}, {", ".join(f"{v} AS {k}" for k, v in sqlgen.reg_exprs('obs', 'pred').items() if k in ('RMSE', 'MAE', 'R2'))}
FROM c GROUP BY {KS}""")
def q_v15(spark, sf):
    return metrics.pred_vs_observed(predictions(spark, sf), KEYS)


DESC_COLS = list(COMFORT_SPEC.num_cols) + ["target"]
_DESC_LONG = " UNION ALL ".join(f"SELECT environment, '{c}' AS column_name, {c} AS x FROM comfort" for c in DESC_COLS)


@register("V16_describe_summary", P + f""",
long AS ({_DESC_LONG})
SELECT environment, column_name, count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std,
       round(min(x), 6) AS min, round(max(x), 6) AS max, CAST(sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_values,
       round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50,
       round(quantile_cont(x, 0.75), 6) AS p75
FROM long GROUP BY ALL""")
def q_v16(spark, sf):
    return metrics.describe_summary(comfort(spark, sf), "environment", DESC_COLS)


_CORR = " UNION ALL ".join(
    f"SELECT environment, '{a}' AS var_a, '{b}' AS var_b, corr({a}, {b}) AS r, "
    f"count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n FROM comfort GROUP BY environment"
    for a in DESC_COLS for b in DESC_COLS)


@register("V17_correlation_matrix", P + f"\nSELECT environment, var_a, var_b, round(r, 6) AS r, n FROM ({_CORR})")
def q_v17(spark, sf):
    return metrics.correlation_matrix(comfort(spark, sf), "environment", DESC_COLS)


CAL_SQL = PREDICTIONS_SQL + f""",
bias AS (SELECT {KS}, round(avg(y_true - y_pred), 12) AS bias FROM preds GROUP BY ALL),
cal AS (SELECT {KS}, b.bias, quantile_cont(abs(y_true - y_pred - b.bias), 0.9) AS qhat
        FROM preds p JOIN bias b USING ({KS}) GROUP BY ALL)"""


@register("C01_bias_and_qhat", with_sql(CAL_SQL) + f"SELECT {KS}, round(bias, 6) AS bias, round(qhat, 6) AS qhat FROM cal")
def q_c01(spark, sf):
    return calib.bias_and_qhat(predictions(spark, sf), KEYS)


@register("C02_apply_calibration", with_sql(CAL_SQL) + f"""
SELECT row_id, {KS}, round(greatest(-3.0::double, least(3.0::double, y_pred + bias)), 6) AS y_cal
FROM preds JOIN cal USING ({KS})""")
def q_c02(spark, sf):
    p = predictions(spark, sf)
    cal = calib.bias_and_qhat(p, KEYS)
    return calib.apply_calibration(p, cal, KEYS).select("row_id", *KEYS, "y_cal")


@register("C03_prediction_interval", with_sql(CAL_SQL) + f""",
c AS (SELECT row_id, {KS}, y_pred, bias, qhat,
             greatest(-3.0::double, least(3.0::double, y_pred + bias)) AS y_cal FROM preds JOIN cal USING ({KS}))
SELECT row_id, {KS},
  round(CASE WHEN model = 'stacked_ensemble' THEN y_cal - qhat
        ELSE greatest(-3.0::double, least(3.0::double, y_pred + bias - qhat)) END, 6) AS lower,
  round(CASE WHEN model = 'stacked_ensemble' THEN y_cal + qhat
        ELSE greatest(-3.0::double, least(3.0::double, y_pred + bias + qhat)) END, 6) AS upper
FROM c""")
def q_c03(spark, sf):
    p = predictions(spark, sf)
    cal = calib.apply_calibration(p, calib.bias_and_qhat(p, KEYS), KEYS)
    stack = calib.prediction_interval(cal.where(F.col("model") == "stacked_ensemble"), clip_bounds=False)
    base = calib.prediction_interval(cal.where(F.col("model") != "stacked_ensemble"), clip_bounds=True)
    return stack.unionByName(base).select("row_id", *KEYS, "lower", "upper")
