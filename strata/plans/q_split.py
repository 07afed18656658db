"""Queries K01-K05 and the shared fold bindings used by later query modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import split
from ..session import staged
from ..sources.tables import COMFORT_SQL, comfort, comfort_rows, with_sql
from .catalog import register

NUM = ("f_total", "f_lines", "f_qty", "f_disc", "f_tax")

FOLDS_SQL = COMFORT_SQL + """,
folds AS (SELECT *, CAST((row_number() OVER (PARTITION BY environment
            ORDER BY md5('42|0|' || row_id), row_id) - 1) % 5 AS INTEGER) AS fold FROM comfort)"""

LONG_SQL = FOLDS_SQL + ",\nlong AS (\n" + "\n  UNION ALL\n".join(
    f"  SELECT row_id, environment, fold, '{c}' AS feature, {c} AS value FROM folds" for c in NUM) + "\n)"

KS_SQL = "ks AS (SELECT CAST(range AS INTEGER) AS k FROM range(5))"


def comfort_folds(spark, sf, n=5, seed=42):
    return split.kfold(comfort(spark, sf), n=n, seed=seed)


def placed_folds(spark, sf, n=5, seed=42):
    """The folds, written once for the passes over them, with each row's place in its fold."""
    return staged(split.kfold(comfort_rows(spark, sf), n=n, seed=seed, pos="place"), "folds")


@register("K01_kfold", with_sql(FOLDS_SQL) + "SELECT row_id, environment, fold FROM folds")
def q_k01(spark, sf):
    return comfort_folds(spark, sf).select("row_id", "environment", "fold")


def _bins_sql(n_bins=7):
    ps = [repr(i / n_bins) for i in range(n_bins + 1)]
    qs = ", ".join(f"quantile_cont(target, {p}::double)" for p in ps)
    return COMFORT_SQL + f""",
edges0 AS (SELECT environment, list_sort(list_distinct([{qs}])) AS e,
                  min(target) AS mn, max(target) AS mx FROM comfort GROUP BY environment),
edges AS (SELECT environment, CASE WHEN len(e) <= 2
            THEN [mn + cast(i AS double) * ((mx - mn) / {float(n_bins)!r}::double) FOR i IN range({n_bins + 1})]
            ELSE e END AS e FROM edges0),
binned AS (SELECT c.*, CAST(len(list_filter(e[2:len(e)-1], lambda x: x < c.target)) AS INTEGER) AS bin
           FROM comfort c JOIN edges USING (environment))"""


BINS_SQL = _bins_sql()


@register("K02_target_bins", with_sql(BINS_SQL) + "SELECT row_id, environment, bin FROM binned")
def q_k02(spark, sf):
    return split.target_bins(comfort(spark, sf)).select("row_id", "environment", "bin")


STRAT_SQL = BINS_SQL + """,
strat_ok AS (SELECT environment, max(c) >= 5 AS ok FROM
             (SELECT environment, bin, count(*) AS c FROM binned GROUP BY ALL) GROUP BY environment),
sfolds AS (SELECT b.*, CAST((row_number() OVER (PARTITION BY b.environment,
             CASE WHEN s.ok THEN CAST(b.bin AS VARCHAR) ELSE '*' END
             ORDER BY md5('42|0|' || b.row_id), b.row_id) - 1) % 5 AS INTEGER) AS fold
           FROM binned b JOIN strat_ok s USING (environment))"""


def comfort_strat_folds(spark, sf, n=5, seed=42):
    return split.stratified_kfold(split.target_bins(comfort(spark, sf)), "bin", n=n, seed=seed)


@register("K03_stratified_kfold", with_sql(STRAT_SQL) + "SELECT row_id, environment, bin, fold FROM sfolds")
def q_k03(spark, sf):
    return comfort_strat_folds(spark, sf).select("row_id", "environment", "bin", "fold")


@register("K04_repeated_cv", with_sql(BINS_SQL) + """,
reps AS (SELECT b.*, CAST(r.range AS INTEGER) AS rep FROM binned b, range(3) r),
ok AS (SELECT environment, rep, max(c) >= 5 AS ok FROM
       (SELECT environment, rep, bin, count(*) c FROM reps GROUP BY ALL) GROUP BY ALL)
SELECT row_id, environment, rep, CAST((row_number() OVER (PARTITION BY r.environment, r.rep,
         CASE WHEN ok.ok THEN CAST(bin AS VARCHAR) ELSE '*' END
         ORDER BY md5(CAST(42 + r.rep AS VARCHAR) || '|0|' || row_id), row_id) - 1) % 5 AS INTEGER) AS fold
FROM reps r JOIN ok USING (environment, rep)""")
def q_k04(spark, sf):
    b = split.target_bins(comfort(spark, sf))
    return split.repeated_folds(b, repeats=3, stratum="bin").select("row_id", "environment", "rep", "fold")


@register("K05_leave_one_environment_out", with_sql(COMFORT_SQL) + """
SELECT environment AS test_env, count(*) AS n_test,
       (SELECT count(*) FROM comfort) - count(*) AS n_train FROM comfort GROUP BY environment""")
def q_k05(spark, sf):
    return split.loeo_sizes(split.leave_one_environment_out(comfort(spark, sf)))
