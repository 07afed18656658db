"""Queries T01-T09 (fold scope uses the K01 folds of the comfort view)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prep
from ..session import staged
from ..sources.tables import COMFORT_SQL, COMFORT_SPEC, comfort, with_sql
from .catalog import register
from .q_split import KS_SQL, LONG_SQL, comfort_folds, placed_folds

ENV = "environment"
K = 5

TRAIN_SQL = LONG_SQL + ",\n" + KS_SQL + """,
train AS (SELECT l.environment, ks.k, l.feature, l.value FROM long l JOIN ks ON l.fold <> ks.k),
med AS (SELECT environment, k, feature, quantile_cont(value, 0.5) AS median FROM train GROUP BY ALL),
imp AS (SELECT t.environment, t.k, t.feature, coalesce(t.value, m.median) AS value
        FROM train t JOIN med m USING (environment, k, feature)),
cap AS (SELECT environment, k, feature,
               quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lower,
               quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS upper
        FROM imp GROUP BY ALL),
capped AS (SELECT i.environment, i.k, i.feature, greatest(c.lower, least(c.upper, i.value)) AS value
           FROM imp i JOIN cap c USING (environment, k, feature)),
sc AS (SELECT environment, k, feature, quantile_cont(value, 0.5) AS center,
              CASE WHEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) = 0 THEN 1.0
                   ELSE quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END AS scale
       FROM capped GROUP BY ALL)"""


def _fold_long(spark, sf, folds=comfort_folds):
    return prep.long_numeric(folds(spark, sf), COMFORT_SPEC)


def _counts(spark, sf):
    return prep.context_counts(_fold_long(spark, sf), ENV, "value", K)


KEYS = [ENV, prep.FOLD_CTX, "feature"]


@register("T01_impute_median", with_sql(TRAIN_SQL) +
          "SELECT environment, k, feature, round(median, 6) AS median FROM med")
def q_t01(spark, sf):
    return prep.fit_median(_counts(spark, sf), KEYS)


@register("T02_impute_mode", with_sql(COMFORT_SQL) + """,
folds AS (SELECT *, CAST((row_number() OVER (PARTITION BY environment
            ORDER BY md5('42|0|' || row_id), row_id) - 1) % 5 AS INTEGER) AS fold FROM comfort),
lc AS (SELECT environment, fold, 'season' AS feature, season AS level FROM folds
       UNION ALL SELECT environment, fold, 'clothing', clothing FROM folds
       UNION ALL SELECT environment, fold, 'activity', activity FROM folds),
""" + KS_SQL + """,
cnt AS (SELECT environment, k, feature, level, count(*) AS n FROM lc JOIN ks ON lc.fold <> ks.k
        WHERE level IS NOT NULL GROUP BY ALL)
SELECT environment, k, feature, level AS mode FROM (
  SELECT *, row_number() OVER (PARTITION BY environment, k, feature ORDER BY n DESC, level) AS r FROM cnt)
WHERE r = 1""")
def q_t02(spark, sf):
    lc = prep.long_categorical(comfort_folds(spark, sf), COMFORT_SPEC)
    return prep.fit_mode(lc, ENV, K)


@register("T03_cap_iqr", with_sql(TRAIN_SQL) +
          "SELECT environment, k, feature, round(lower, 6) AS lower, round(upper, 6) AS upper FROM cap")
def q_t03(spark, sf):
    c = staged(_counts(spark, sf), "counts")
    med = prep.small_table(prep.fit_median(c, KEYS))
    return prep.fit_cap(c, med, KEYS)


@register("T04_robust_scale", with_sql(TRAIN_SQL) +
          "SELECT environment, k, feature, round(center, 6) AS center, round(scale, 6) AS scale FROM sc")
def q_t04(spark, sf):
    return prep.fit_numeric(_fold_long(spark, sf, placed_folds), ENV, K).select(*KEYS, "center", "scale")


@register("T05_one_hot", with_sql(COMFORT_SQL) + """,
folds AS (SELECT *, CAST((row_number() OVER (PARTITION BY environment
            ORDER BY md5('42|0|' || row_id), row_id) - 1) % 5 AS INTEGER) AS fold FROM comfort),
lc AS (SELECT row_id, environment, fold, 'season' AS feature, season AS level FROM folds
       UNION ALL SELECT row_id, environment, fold, 'clothing', clothing FROM folds
       UNION ALL SELECT row_id, environment, fold, 'activity', activity FROM folds),
""" + KS_SQL + """,
cnt AS (SELECT environment, k, feature, level, count(*) AS n FROM lc JOIN ks ON lc.fold <> ks.k
        WHERE level IS NOT NULL GROUP BY ALL),
mode AS (SELECT environment, k, feature, level AS mode FROM (
  SELECT *, row_number() OVER (PARTITION BY environment, k, feature ORDER BY n DESC, level) AS r FROM cnt) WHERE r = 1),
lv AS (SELECT DISTINCT t.environment, t.k, t.feature, coalesce(t.level, m.mode) AS train_level
       FROM (SELECT lc.*, ks.k FROM lc JOIN ks ON lc.fold <> ks.k) t JOIN mode m USING (environment, k, feature)),
lvi AS (SELECT *, CAST(row_number() OVER (PARTITION BY environment, k, feature ORDER BY train_level) - 1 AS INTEGER)
        AS level_index FROM lv)
SELECT lc.row_id, lc.fold, lc.feature, lvi.train_level, lvi.level_index,
       CAST(coalesce(lc.level, m.mode) = lvi.train_level AS INTEGER) AS hot
FROM lc JOIN mode m ON m.environment = lc.environment AND m.k = lc.fold AND m.feature = lc.feature
JOIN lvi ON lvi.environment = lc.environment AND lvi.k = lc.fold AND lvi.feature = lc.feature""")
def q_t05(spark, sf):
    lc = prep.long_categorical(comfort_folds(spark, sf), COMFORT_SPEC)
    mode = prep.fit_mode(lc, ENV, K)
    levels = prep.fit_levels(lc, mode, ENV, K)
    return prep.one_hot(lc, mode, levels, ENV, K).select(
        "row_id", "fold", "feature", "train_level", "level_index", "hot")


@register("T06_category_codes", with_sql(COMFORT_SQL) + """,
nulled AS (SELECT row_id, environment, CASE WHEN f_lines IS NULL THEN NULL ELSE clothing END AS clothing,
                  season FROM comfort)
SELECT row_id, environment,
  coalesce(CAST(dense_rank() OVER (PARTITION BY environment, clothing IS NULL ORDER BY clothing) - 1 AS INTEGER)
           * CASE WHEN clothing IS NULL THEN NULL ELSE 1 END, -1) AS clothing_code,
  CAST(dense_rank() OVER (PARTITION BY environment ORDER BY season) - 1 AS INTEGER) AS season_code
FROM nulled""")
def q_t06(spark, sf):
    cf = comfort(spark, sf).select(
        "row_id", ENV, F.when(F.col("f_lines").isNull(), F.lit(None)).otherwise(F.col("clothing")).alias("clothing"),
        "season")
    return prep.category_codes(cf, ENV, ["clothing", "season"]).select("row_id", ENV, "clothing_code", "season_code")


@register("T07_fit_fold_preprocessor", with_sql(TRAIN_SQL) + """
SELECT l.row_id, l.fold, l.feature,
       round((greatest(c.lower, least(c.upper, coalesce(l.value, m.median))) - s.center) / s.scale, 6) AS scaled
FROM long l JOIN med m ON m.environment = l.environment AND m.k = l.fold AND m.feature = l.feature
JOIN cap c ON c.environment = l.environment AND c.k = l.fold AND c.feature = l.feature
JOIN sc s ON s.environment = l.environment AND s.k = l.fold AND s.feature = l.feature""")
def q_t07(spark, sf):
    ln = _fold_long(spark, sf, placed_folds)
    stats = prep.fit_numeric(ln, ENV, K)
    return prep.apply_numeric(ln, stats, ENV, K).select("row_id", "fold", "feature", "scaled")


@register("T08_preprocess_global", with_sql(COMFORT_SQL) + """,
long AS (""" + "\n  UNION ALL\n".join(
    f"  SELECT row_id, environment, '{c}' AS feature, {c} AS value FROM comfort" for c in COMFORT_SPEC.num_cols) + """),
med AS (SELECT environment, feature, quantile_cont(value, 0.5) AS median FROM long GROUP BY ALL),
imp AS (SELECT l.row_id, l.environment, l.feature, coalesce(l.value, m.median) AS value
        FROM long l JOIN med m USING (environment, feature)),
cap AS (SELECT environment, feature,
          quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lower,
          quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS upper
        FROM imp GROUP BY ALL),
capped AS (SELECT i.row_id, i.environment, i.feature, greatest(c.lower, least(c.upper, i.value)) AS value
           FROM imp i JOIN cap c USING (environment, feature)),
sc AS (SELECT environment, feature, quantile_cont(value, 0.5) AS center,
         CASE WHEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) = 0 THEN 1.0
              ELSE quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END AS scale FROM capped GROUP BY ALL),
lc AS (SELECT row_id, environment, 'season' AS feature, season AS level FROM comfort
       UNION ALL SELECT row_id, environment, 'clothing', clothing FROM comfort
       UNION ALL SELECT row_id, environment, 'activity', activity FROM comfort),
mode AS (SELECT environment, feature, level AS mode FROM (SELECT *, row_number() OVER
          (PARTITION BY environment, feature ORDER BY n DESC, level) AS r FROM
          (SELECT environment, feature, level, count(*) n FROM lc WHERE level IS NOT NULL GROUP BY ALL)) WHERE r = 1),
cimp AS (SELECT l.row_id, l.environment, l.feature, coalesce(l.level, m.mode) AS level
         FROM lc l JOIN mode m USING (environment, feature))
SELECT c.row_id, c.environment, c.feature, round(c.value, 6) AS original,
       round((c.value - s.center) / s.scale, 6) AS scaled, NULL::varchar AS level
FROM capped c JOIN sc s USING (environment, feature)
UNION ALL
SELECT row_id, environment, feature, NULL::double, CAST(dense_rank() OVER (PARTITION BY environment, feature
       ORDER BY level) - 1 AS DOUBLE), level FROM cimp""")
def q_t08(spark, sf):
    return prep.preprocess_global(staged(comfort(spark, sf), "comfort"), COMFORT_SPEC)


@register("T09_align_like_train", with_sql(COMFORT_SQL) + """
SELECT row_id, environment, round(f_qty, 6) AS f_qty, NULL::double AS f_disc, NULL::double AS f_tax,
       season, round(target, 6) AS target FROM comfort""")
def q_t09(spark, sf):
    cf = comfort(spark, sf)
    test = cf.select("row_id", ENV, "target", "f_qty", "season", "f_total")
    train_cols = ["row_id", ENV, "f_qty", "f_disc", "f_tax", "season", "target"]
    out = prep.align_like_train(test, train_cols)
    return out.select(*[F.col(c).cast("double") if c in ("f_disc", "f_tax") else F.col(c) for c in train_cols])
