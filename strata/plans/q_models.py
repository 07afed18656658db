"""Queries M01-M04, M11, M15 (linear family on Gram sums, exact kNN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grams, knn, models
from ..session import staged
from ..sources.tables import COMFORT_SPEC
from .catalog import register
from .q_prep import TRAIN_SQL
from .q_split import placed_folds
from ..sources.tables import with_sql

SPEC = COMFORT_SPEC
K = 5

XT_SQL = TRAIN_SQL + """,
xt AS (SELECT l.row_id, l.environment, l.fold, ks.k, l.feature,
          (greatest(c.lower, least(c.upper, coalesce(l.value, m.median))) - s.center) / s.scale AS x
       FROM long l CROSS JOIN ks
       JOIN med m ON m.environment = l.environment AND m.k = ks.k AND m.feature = l.feature
       JOIN cap c ON c.environment = l.environment AND c.k = ks.k AND c.feature = l.feature
       JOIN sc s ON s.environment = l.environment AND s.k = ks.k AND s.feature = l.feature),
tg AS (SELECT row_id, target FROM folds),
fit AS (SELECT xt.environment, xt.k, xt.feature, regr_slope(tg.target, xt.x) AS slope,
               regr_intercept(tg.target, xt.x) AS icpt
        FROM xt JOIN tg USING (row_id) WHERE xt.fold <> xt.k GROUP BY ALL),
oof AS (SELECT xt.row_id, xt.environment, xt.fold, xt.k, 'ols_' || xt.feature AS model, xt.feature, xt.x,
               tg.target AS y_true, fit.slope, fit.icpt + fit.slope * xt.x AS y_pred
        FROM xt JOIN fit USING (environment, k, feature) JOIN tg USING (row_id) WHERE xt.fold = xt.k)"""


# One OLS model per numeric feature.
SINGLE = {f"ols_{f}": {"kind": "ols", "active": [i]} for i, f in enumerate(SPEC.num_cols)}


def design(spark, sf, cf=None):
    """Numeric design (fold-scaled features) -- the form the SQL oracles reproduce."""
    return models.design_rows(placed_folds(spark, sf) if cf is None else cf, SPEC, K)


def design_full(spark, sf, cf=None):
    """Numeric + fold-fitted one-hot categorical design (learner input)."""
    cf = placed_folds(spark, sf) if cf is None else cf
    return models.design_rows(cf, SPEC, K, levels=models.categorical_levels(cf, SPEC.cat_cols))


@register("M01_linear_regression", with_sql(XT_SQL) +
          "SELECT row_id, environment, fold, model, round(y_true, 6) AS y_true, round(y_pred, 6) AS y_pred FROM oof",
          bench=True)
def q_m01(spark, sf):
    """Out-of-fold predictions of one OLS model per fold-scaled feature."""
    cf = placed_folds(spark, sf)
    contexts = grams.fit(cf, SPEC, K, categorical=False)
    return grams.predict(cf, contexts, staged(grams.fits(grams.cells(cf, contexts), SINGLE), "fits"))


def _gram_oof(spark, sf, learners):
    return grams.oof(placed_folds(spark, sf), SPEC, K, learners)


@register("M01_linear_regression_gram")
def q_m01g(spark, sf):
    """Multi-feature OLS per (environment, fold) from the Gram sums."""
    return _gram_oof(spark, sf, {"linear_regression": models.LINEAR_LEARNERS["linear_regression"]})


@register("M02_ridge")
def q_m02(spark, sf):
    return _gram_oof(spark, sf, {"ridge": models.LINEAR_LEARNERS["ridge"]})


@register("M03_lasso")
def q_m03(spark, sf):
    return _gram_oof(spark, sf, {"lasso": models.LINEAR_LEARNERS["lasso"]})


@register("M04_elasticnet")
def q_m04(spark, sf):
    return _gram_oof(spark, sf, {"elasticnet": models.LINEAR_LEARNERS["elasticnet"]})


@register("M15_oof_predictions")
def q_m15(spark, sf):
    """All four linear learners in one Gram pass -> long OOF table."""
    return _gram_oof(spark, sf, models.LINEAR_LEARNERS)


KNN_FEATURES = list(SPEC.num_cols)
_PIVOT = ", ".join(f"max(CASE WHEN feature = '{f}' THEN x END) AS x{i}" for i, f in enumerate(KNN_FEATURES))
_SQUARES = " + ".join(f"(q.x{i} - t.x{i}) * (q.x{i} - t.x{i})" for i in range(len(KNN_FEATURES)))


@register("M11_knn_distance", with_sql(XT_SQL) + f""",
kx AS (SELECT row_id, environment, fold, k, {_PIVOT} FROM xt GROUP BY ALL),
pr AS (SELECT q.row_id, q.environment, q.k, t.row_id AS tid, tg.target AS ty,
              sqrt({_SQUARES}) AS d
       FROM kx q JOIN kx t ON q.environment = t.environment AND q.k = t.k AND q.fold = q.k AND t.fold <> t.k
       JOIN tg ON tg.row_id = t.row_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, environment, k ORDER BY d, tid) AS r FROM pr)
        WHERE r <= 15),
agg AS (SELECT row_id, environment, k, sum(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END) AS nz,
               sum(CASE WHEN d = 0 THEN ty ELSE 0.0 END) AS zy,
               sum(CASE WHEN d > 0 THEN 1.0 / d ELSE 0.0 END) AS sw,
               sum(CASE WHEN d > 0 THEN ty / d ELSE 0.0 END) AS swy FROM top GROUP BY ALL)
SELECT row_id, environment, k AS fold, 'knn_distance' AS model,
       round(CASE WHEN nz > 0 THEN zy / nz ELSE swy / sw END, 6) AS y_pred FROM agg""", bench=True)
def q_m11(spark, sf):
    """Exact kNN (k = 15) on all fold-scaled numeric features."""
    d, _ = design(spark, sf)
    return knn.knn_predict(d, SPEC, [models.FEATURE_PREFIX + f for f in KNN_FEATURES], k=15)
