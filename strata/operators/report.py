"""Joins, rankings and summaries used for reporting (survey IDs L01-L10).

Leaderboard tables have one row per (environment, model); their windows are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import r6

# Ranking metrics and their direction (True = lower is better).
RANK_METRICS = {"RMSE": True, "MAE": True, "R2": False, "Accuracy": False,
                "Kappa_quadratic": False, "Kendall_tau_b": False}
# Pipeline comparison metrics; signed MBE is "lower is better" (quirk kept).
COMPARE_METRICS = ("RMSE", "MAE", "R2", "Accuracy", "Residual_STD", "MBE")
COMPARE_LOWER_BETTER = ("RMSE", "MAE", "Residual_STD", "MBE")


def combine_results(*frames: DataFrame) -> DataFrame:
    """Stack rows + baseline rows; columns missing on one side become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def rank_models(metrics: DataFrame, env="environment", model="model") -> DataFrame:
    """Per environment by R2 desc, RMSE, MAE, then model name (stable)."""
    w = Window.partitionBy(env).orderBy(F.col("R2").desc_nulls_last(), F.col("RMSE").asc_nulls_last(),
                                        F.col("MAE").asc_nulls_last(), F.col(model))
    return metrics.withColumn("Rank", F.row_number().over(w).cast("bigint"))


def env_winners(ranked: DataFrame) -> DataFrame:
    """The rank-1 model of each environment."""
    return ranked.where(F.col("Rank") == 1)


def rank_by_metric(metrics: DataFrame, env="environment", model="model", metric_dirs=None) -> DataFrame:
    """Long (env, metric, model, value, rank) with each metric's direction."""
    metric_dirs = metric_dirs or RANK_METRICS
    long = metrics.select(env, model, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"),
                 F.lit(low).alias("lower_better")) for m, low in metric_dirs.items()])).alias("m")) \
        .select(env, model, "m.*")
    key = F.when(F.col("lower_better"), F.col("value")).otherwise(-F.col("value"))
    w = Window.partitionBy(env, "metric").orderBy(key.asc_nulls_last(), F.col(model))
    return long.withColumn("metric_rank", F.row_number().over(w).cast("bigint"))


def normalise_env_name(c):
    return F.lower(F.regexp_replace(F.regexp_replace(c, " ", "_"), "/", "_"))


def average_ranks(ranked: DataFrame, env_name: str, env="environment") -> DataFrame:
    """The ranked rows of one environment; exact name first, else tolerant match
    (blank and '/' -> '_', case-insensitive)."""
    exact = ranked.where(F.col(env) == F.lit(env_name))
    tolerant = ranked.where(normalise_env_name(F.col(env)) == F.lit(env_name.lower()))
    has_exact = exact.limit(1).count() > 0  # one-row probe
    return (exact if has_exact else tolerant).select(env, "model", "Rank")


def compare_pipelines(a: DataFrame, b: DataFrame, env="environment", names=("Predicted_TSV", "Adaptive_TSV")) -> DataFrame:
    """Inner join of two metric summaries on environment; per metric the values,
    difference (b - a), verdict, values rounded to 4 places; winner per environment by
    the count of better metrics, else Tie."""
    na, nb = names
    j = a.select(env, *[F.col(m).alias(f"{m}__a") for m in COMPARE_METRICS]).join(
        b.select(env, *[F.col(m).alias(f"{m}__b") for m in COMPARE_METRICS]), env)
    long = j.select(env, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}__a").alias("va"), F.col(f"{m}__b").alias("vb"),
                 F.lit(m in COMPARE_LOWER_BETTER).alias("lower_better")) for m in COMPARE_METRICS])).alias("x")) \
        .select(env, "x.*")
    d = F.col("vb") - F.col("va")
    b_better = F.when(F.col("lower_better"), d < 0).otherwise(d > 0)
    a_better = F.when(F.col("lower_better"), d > 0).otherwise(d < 0)
    long = long.withColumn("better", F.when(b_better, F.lit(f"{nb} is Better"))
                           .when(a_better, F.lit(f"{na} is Better")).otherwise(F.lit("No change")))
    w = Window.partitionBy(env)
    nb_cnt = F.sum(b_better.cast("int")).over(w)
    na_cnt = F.sum(a_better.cast("int")).over(w)
    winner = F.when(nb_cnt > na_cnt, F.lit(nb)).when(na_cnt > nb_cnt, F.lit(na)).otherwise(F.lit("Tie"))
    return long.select(env, "metric", r6("va", 4).alias(na), r6("vb", 4).alias(nb),
                       r6(d, 4).alias("difference"), "better", winner.alias("overall_winner"))


def pool_environments(df: DataFrame, envs, env="environment", pooled_name="Combined") -> DataFrame:
    """Rows of the given environments as one pooled group; the source environment
    is kept as ``sub_environment``."""
    return (df.where(F.col(env).isin(list(envs)))
            .withColumn("sub_environment", F.col(env))
            .withColumn(env, F.lit(pooled_name)))
