"""Queries R01-R11: scores, permutation importance of the per-feature OLS models,
combination, per-fold picks, stability selection and reports."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..session import staged
from ..operators import grams, score
from ..operators.prep import FOLD_CTX
from ..sources.tables import COMFORT_SPEC, with_sql
from .catalog import register
from .q_models import SINGLE, XT_SQL
from .q_split import comfort_folds, placed_folds

ENV = "environment"
K = 5
NUM = list(COMFORT_SPEC.num_cols)
CAT = list(COMFORT_SPEC.cat_cols)
SEED = 42
REPEATS = 3

_UL = " UNION ALL ".join(f"SELECT environment, fold, '{c}' AS feature, {c} AS x, target AS y FROM folds" for c in NUM)
_CL = " UNION ALL ".join(f"SELECT environment, fold, '{c}' AS feature, coalesce({c}, 'nan') AS level, target AS y FROM folds"
                         for c in CAT)

_UNIVARIATE_SQL = XT_SQL + f""",
ul AS ({_UL}),
u1 AS (SELECT u.environment, ks.k, u.feature,
              round(CASE WHEN count(*) < 8 OR var_pop(x) = 0 OR var_pop(y) = 0 THEN 0.0
                         ELSE corr(x, y) * corr(x, y) END, 12) AS score
       FROM ul u JOIN ks ON u.fold <> ks.k WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
cl AS ({_CL}),
ct AS (SELECT c.environment, ks.k, c.feature, c.level, c.y FROM cl c JOIN ks ON c.fold <> ks.k WHERE y IS NOT NULL),
cg AS (SELECT environment, k, feature, avg(y) AS grand, count(DISTINCT level) AS levels FROM ct GROUP BY ALL),
cssb AS (SELECT environment, k, feature, sum(n * (m - grand) * (m - grand)) AS ssb
         FROM (SELECT environment, k, feature, level, count(*) AS n, avg(y) AS m FROM ct GROUP BY ALL)
         JOIN cg USING (environment, k, feature) GROUP BY ALL),
csst AS (SELECT environment, k, feature, sum((y - grand) * (y - grand)) AS sst FROM ct JOIN cg USING (environment, k, feature)
         GROUP BY ALL),
u2 AS (SELECT environment, k, feature, round(CASE WHEN levels >= 2 AND sst > 0 THEN ssb / sst ELSE 0.0 END, 12) AS score
       FROM cg JOIN cssb USING (environment, k, feature) JOIN csst USING (environment, k, feature)),
uall AS (SELECT * FROM u1 UNION ALL SELECT * FROM u2),
ur AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.0
                 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS u
       FROM uall WINDOW w AS (PARTITION BY environment, k)),"""

# One partner of a row for all features of a repeat.
_PARTNERS_SQL = f"""
pn AS (SELECT environment, fold AS k, count(*) AS n, 2305843009213693951 % count(*) AS a FROM folds GROUP BY environment, fold),
ps AS (SELECT environment, k, n, r.range AS rep, CASE r.range WHEN 0 THEN a WHEN 1 THEN a * a % n ELSE a * a % n * a % n END AS a,
              CAST('0x' || substr(md5('{SEED}|' || r.range), 1, 8) AS BIGINT) % n AS b FROM pn, range({REPEATS}) r),
pl AS (SELECT row_id, CAST((row_number() OVER (PARTITION BY environment ORDER BY md5('42|0|' || row_id), row_id) - 1) // 5 AS BIGINT) AS place FROM comfort),
pv AS (SELECT xt.row_id, xt.environment, xt.k, xt.feature, xt.x, pl.place FROM xt JOIN pl USING (row_id) WHERE xt.fold = xt.k),
perm AS (SELECT t.row_id, t.environment, t.k, t.feature, ps.rep, t.x, s.x AS x_perm
         FROM pv s JOIN ps ON ps.environment = s.environment AND ps.k = s.k
         JOIN pv t ON t.environment = s.environment AND t.k = s.k AND t.feature = s.feature AND t.place = (ps.a * s.place + ps.b) % ps.n),"""

# A permutation of its own for every feature and repeat.
_SHUFFLED_SQL = f"""
pv AS (SELECT xt.row_id, xt.environment, xt.k, xt.feature, r.range AS rep, xt.x FROM xt, range({REPEATS}) r WHERE xt.fold = xt.k),
pa AS (SELECT *, row_number() OVER (PARTITION BY environment, k, feature, rep ORDER BY row_id) AS pos FROM pv),
pb AS (SELECT environment, k, feature, rep, x AS x_perm, row_number() OVER (PARTITION BY environment, k, feature, rep
         ORDER BY md5('{SEED}|' || feature || '|' || rep || '|' || row_id), row_id) AS pos FROM pv),
perm AS (SELECT pa.row_id, pa.environment, pa.k, pa.feature, pa.rep, pa.x, pb.x_perm FROM pa JOIN pb USING (environment, k, feature, rep, pos)),"""

_SELECTION_SQL = """
pp AS (SELECT o.environment, o.k, o.model, p.feature, p.rep, o.y_true,
              o.y_pred + CASE WHEN p.feature = o.feature THEN o.slope ELSE 0.0 END * (p.x_perm - p.x) AS yp
       FROM oof o JOIN perm p ON p.row_id = o.row_id AND p.environment = o.environment AND p.k = o.k),
bm AS (SELECT environment, k, model, 1.0 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) AS r2,
              avg(abs(y_true - y_pred)) AS mae,
              avg(CASE WHEN abs(y_true - y_pred) <= 0.5 THEN 1.0 ELSE 0.0 END) AS acc FROM oof GROUP BY ALL),
pm AS (SELECT environment, k, model, feature, rep,
              1.0 - sum((y_true - yp) * (y_true - yp)) / (var_pop(y_true) * count(*)) AS r2,
              avg(abs(y_true - yp)) AS mae, avg(CASE WHEN abs(y_true - yp) <= 0.5 THEN 1.0 ELSE 0.0 END) AS acc
       FROM pp GROUP BY ALL),
r4 AS (SELECT environment, k, model, feature, round(avg(greatest(0.0, b.r2 - p.r2)), 12) AS dR2,
              round(avg(greatest(0.0, p.mae - b.mae)), 12) AS dMAE, round(avg(greatest(0.0, b.acc - p.acc)), 12) AS dAcc
       FROM pm p JOIN bm b USING (environment, k, model) GROUP BY ALL),
pr AS (SELECT *, CASE WHEN max(dR2) OVER w = min(dR2) OVER w THEN 0.0
                 ELSE (dR2 - min(dR2) OVER w) / (max(dR2) OVER w - min(dR2) OVER w) END AS p
       FROM r4 WINDOW w AS (PARTITION BY environment, k, model)),
comb AS (SELECT ur.environment, ur.k, m.model, ur.feature, ur.u, coalesce(pr.p, 0.0) AS p,
                0.4 * ur.u + 0.6 * coalesce(pr.p, 0.0) AS combined
         FROM ur JOIN (SELECT DISTINCT environment, k, model FROM pr) m USING (environment, k)
         LEFT JOIN pr USING (environment, k, model, feature)),
picks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY environment, k, model
            ORDER BY combined DESC, feature) AS pick_rank FROM comb) WHERE pick_rank <= 7),
fr AS (SELECT environment, model, feature, count(*) / 5.0::double AS freq FROM picks GROUP BY ALL),
ms AS (SELECT environment, model, feature, avg(combined) AS mean_score FROM comb GROUP BY ALL),
st0 AS (SELECT ms.*, coalesce(fr.freq, 0.0) AS freq, coalesce(fr.freq, 0.0) >= 0.6 AS elig
        FROM ms LEFT JOIN fr USING (environment, model, feature)),
st1 AS (SELECT *, max(CAST(elig AS INTEGER)) OVER (PARTITION BY environment, model) AS anye,
               row_number() OVER (PARTITION BY environment, model, elig ORDER BY mean_score DESC, feature) AS re,
               row_number() OVER (PARTITION BY environment, model ORDER BY mean_score DESC, feature) AS ra FROM st0),
stab AS (SELECT environment, model, feature, freq, mean_score,
                CASE WHEN anye = 1 THEN elig AND re <= 7 ELSE ra <= 3 END AS selected FROM st1)"""

SCORE_SQL = _UNIVARIATE_SQL + _PARTNERS_SQL + _SELECTION_SQL
SHUFFLED_SQL = _UNIVARIATE_SQL + _SHUFFLED_SQL + _SELECTION_SQL


class Scores:
    """The scoring pipeline of one run (shared by the R queries); a query computes the parts that it reads.

    ``shuffled``: permutation scores on a permutation of its own for every feature and repeat,
    else on one partner of a row for all features of a repeat.
    """

    def __init__(self, spark, sf, shuffled: bool = False):
        self.cf, self.shuffled = placed_folds(spark, sf), shuffled

    @cached_property
    def uall(self):
        u1 = score.univariate_r2(self.cf, ENV, "fold", "target", NUM, K)
        u2 = score.eta_squared(self.cf, ENV, "fold", "target", CAT, K)
        return staged(u1.unionByName(u2).withColumn("score", r6("score", 12)), "scores")

    @cached_property
    def ur(self):
        return score.minmax_rank(self.uall, [ENV, FOLD_CTX], out="u")

    @cached_property
    def r4(self):
        """Permutation scores of one OLS model per feature."""
        contexts = grams.fit(self.cf, COMFORT_SPEC, K, categorical=False)
        fits = staged(grams.fits(grams.cells(self.cf, contexts), SINGLE), "fits")
        found = grams.importance(self.cf, contexts, fits, None if self.shuffled else "place", REPEATS, SEED)
        return staged(found.select(ENV, FOLD_CTX, "model", "feature", *[r6(c, 12).alias(c) for c in ("dR2", "dMAE", "dAcc")]), "importance")

    @cached_property
    def comb(self):
        pr = score.minmax_rank(self.r4, [ENV, FOLD_CTX, "model"], value="dR2", out="p")
        return staged(score.combine_scores(self.ur.select(ENV, FOLD_CTX, "feature", "u"), pr.select(ENV, FOLD_CTX, "model", "feature", "p"), [ENV, FOLD_CTX]), "combined")

    @cached_property
    def picks(self):
        return score.top_m(self.comb, [ENV, FOLD_CTX, "model"], 7)

    @cached_property
    def stab(self):
        return score.stability_selection(self.picks, self.comb, [ENV, "model"], K)


@register("R01_univariate_r2", with_sql(SCORE_SQL) + "SELECT environment, k, feature, round(score, 6) AS score FROM u1",
          bench=True)
def q_r01(spark, sf):
    cf = comfort_folds(spark, sf)
    return score.univariate_r2(cf, ENV, "fold", "target", NUM, K).withColumn("score", r6("score", 12))


@register("R02_eta_squared", with_sql(SCORE_SQL) + "SELECT environment, k, feature, round(score, 6) AS score FROM u2")
def q_r02(spark, sf):
    cf = comfort_folds(spark, sf)
    return score.eta_squared(cf, ENV, "fold", "target", CAT, K).withColumn("score", r6("score", 12))


@register("R03_minmax_rank", with_sql(SCORE_SQL) + "SELECT environment, k, feature, round(score, 6) AS score, "
          "round(u, 6) AS u FROM ur")
def q_r03(spark, sf):
    return Scores(spark, sf).ur


@register("R04_permutation_importance", with_sql(SCORE_SQL) +
          "SELECT environment, k, model, feature, round(dR2, 6) AS dR2, round(dMAE, 6) AS dMAE, round(dAcc, 6) AS dAcc FROM r4")
def q_r04(spark, sf):
    return Scores(spark, sf).r4


@register("R05_combine_scores", with_sql(SHUFFLED_SQL) +
          "SELECT environment, k, model, feature, round(u, 6) AS u, round(p, 6) AS p, round(combined, 6) AS combined FROM comb")
def q_r05(spark, sf):
    return Scores(spark, sf, shuffled=True).comb


@register("R06_top_m_per_fold", with_sql(SHUFFLED_SQL) +
          "SELECT environment, k, model, feature, round(combined, 6) AS combined, pick_rank FROM picks")
def q_r06(spark, sf):
    return Scores(spark, sf, shuffled=True).picks.select(ENV, FOLD_CTX, "model", "feature", "combined",
                                                         F.col("pick_rank").cast("bigint").alias("pick_rank"))


@register("R07_global_scope", with_sql(SHUFFLED_SQL) + """,
g AS (SELECT environment, k, feature, avg(combined) AS combined FROM comb GROUP BY ALL),
gt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY environment, k ORDER BY combined DESC, feature) AS pick_rank
       FROM g) WHERE pick_rank <= 7)
SELECT m.environment, m.k, m.model, gt.feature, round(gt.combined, 6) AS combined, gt.pick_rank
FROM (SELECT DISTINCT environment, k, model FROM comb) m JOIN gt USING (environment, k)""")
def q_r07(spark, sf):
    s = Scores(spark, sf, shuffled=True)
    g = score.global_scope(s.comb, [ENV, FOLD_CTX], 7)
    return g.select(ENV, FOLD_CTX, "model", "feature", "combined", F.col("pick_rank").cast("bigint").alias("pick_rank"))


@register("R08_stability_selection", with_sql(SCORE_SQL) +
          "SELECT environment, model, feature, round(freq, 6) AS freq, round(mean_score, 6) AS mean_score, selected FROM stab",
          bench=True)
def q_r08(spark, sf):
    return Scores(spark, sf).stab


@register("R09_selection_report", with_sql(SHUFFLED_SQL) + f""",
rep AS (SELECT s.environment, s.model, s.feature AS Feature,
          CASE WHEN s.feature IN ({", ".join(f"'{c}'" for c in score.SURVEY_CATEGORICALS)}) THEN 'categorical'
               ELSE 'numeric' END AS Type,
          coalesce(u.us, 0.0) AS Univariate_Score, coalesce(p.a, 0.0) AS Perm_DeltaR2, coalesce(p.b, 0.0) AS Perm_DeltaMAE,
          coalesce(p.c, 0.0) AS Perm_DeltaAcc, coalesce(c.cs, 0.0) AS Combined_Score, s.freq AS Stability_Freq,
          s.selected AS Selected
        FROM stab s
        LEFT JOIN (SELECT environment, model, feature, avg(combined) AS cs FROM comb GROUP BY ALL) c
             USING (environment, model, feature)
        LEFT JOIN (SELECT environment, feature, avg(score) AS us FROM uall GROUP BY ALL) u USING (environment, feature)
        LEFT JOIN (SELECT environment, model, feature, avg(dR2) AS a, avg(dMAE) AS b, avg(dAcc) AS c FROM r4 GROUP BY ALL) p
             USING (environment, model, feature))
SELECT environment, model, Feature, Type, round(Univariate_Score, 6) AS Univariate_Score,
       round(Perm_DeltaR2, 6) AS Perm_DeltaR2, round(Perm_DeltaMAE, 6) AS Perm_DeltaMAE,
       round(Perm_DeltaAcc, 6) AS Perm_DeltaAcc, round(Combined_Score, 6) AS Combined_Score,
       round(Stability_Freq, 6) AS Stability_Freq, Selected,
       row_number() OVER (PARTITION BY environment, model ORDER BY Selected DESC, Combined_Score DESC, Feature) AS Rank
FROM rep""")
def q_r09(spark, sf):
    s = Scores(spark, sf, shuffled=True)
    return score.selection_report(s.stab, s.uall.withColumnRenamed(FOLD_CTX, "fold"), s.r4, s.comb, [ENV])


@register("R10_feature_stability", with_sql(SCORE_SQL) + """
SELECT environment, feature, round(freq_sum, 6) AS freq_sum, stability_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY environment ORDER BY freq_sum DESC, feature) AS stability_rank
  FROM (SELECT environment, feature, sum(freq) AS freq_sum FROM stab GROUP BY ALL)) WHERE stability_rank <= 20""")
def q_r10(spark, sf):
    return score.feature_stability(Scores(spark, sf).stab, [ENV], 20)


@register("R11_selected_union", with_sql(SCORE_SQL) + "SELECT DISTINCT environment, feature FROM stab WHERE selected")
def q_r11(spark, sf):
    return score.selected_union(Scores(spark, sf).stab, [ENV])
