"""Splitting operators (survey IDs K01-K05).

Folds are a column, written once and reused by every later pass.  Fold order is a
seeded MD5 permutation of ``row_id`` (identical in any SQL engine), numbered with the
salted row number so a big environment is numbered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import join_stats
from ..functions.quantiles import quantiles_from_counts, value_counts
from ..functions.ranks import salted_row_number


def hash_key(seed: int, row_id: str, rep=0):
    """``md5('<seed>|<rep>|<row_id>')`` -- the shuffle order of a row."""
    rep_c = F.lit(str(rep)) if isinstance(rep, int) else F.col(rep)
    return F.md5(F.concat(F.lit(f"{seed}|"), rep_c.cast("string"), F.lit("|"), F.col(row_id).cast("string")))


def kfold(df: DataFrame, n: int = 5, seed: int = 42, keys=("environment",), row_id: str = "row_id",
          out: str = "fold", rep=0, salt_chars: int = 3, pos: str | None = None) -> DataFrame:
    """Shuffled k-fold per group; fold sizes differ by at most one.  ``pos`` names a column
    for the row's place (from 0) in the shuffled order of its fold."""
    d = df.withColumn("_hk", hash_key(seed, row_id, rep))
    d = salted_row_number(d, list(keys), "_hk", row_id, out="_rn", salt_chars=salt_chars)
    if pos:
        d = d.withColumn(pos, F.floor((F.col("_rn") - 1) / n).cast("long"))
    return d.withColumn(out, ((F.col("_rn") - 1) % n).cast("int")).drop("_hk", "_rn")


def target_bins(df: DataFrame, target: str = "target", keys=("environment",), n_bins: int = 7,
                out: str = "bin", per_octave: int = 4096) -> DataFrame:
    """bin = number of inner quantile edges strictly below y; with <= 2 distinct
    edges the edges are equal-width between min and max."""
    keys = list(keys)
    probs = [i / n_bins for i in range(n_bins + 1)]
    q = quantiles_from_counts(value_counts(df, keys, target), keys, probs, per_octave=per_octave)
    edges = q.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.collect_list("q"))).alias("_e"),
        F.min("q").alias("_mn"), F.max("q").alias("_mx"))
    lin = F.transform(F.sequence(F.lit(0), F.lit(n_bins)),
                      lambda i: F.col("_mn") + i.cast("double") * ((F.col("_mx") - F.col("_mn")) / F.lit(float(n_bins))))
    edges = edges.withColumn("_e", F.when(F.size("_e") <= 2, lin).otherwise(F.col("_e")))
    inner = F.slice("_e", 2, F.size("_e") - 2)
    return (join_stats(df, edges, keys, "left")
            .withColumn(out, F.size(F.filter(inner, lambda e: e < F.col(target))).cast("int"))
            .drop("_e", "_mn", "_mx"))


def stratified_kfold(df: DataFrame, stratum: str, n: int = 5, seed: int = 42, keys=("environment",),
                     row_id: str = "row_id", out: str = "fold", rep=0, salt_chars: int = 3) -> DataFrame:
    """K-fold inside each (group, stratum); a group whose every stratum has fewer
    than ``n`` rows falls back to plain K01 (stratification impossible)."""
    keys = list(keys)
    sizes = df.groupBy(*keys, stratum).agg(F.count(F.lit(1)).alias("_sn"))
    feasible = sizes.groupBy(*keys).agg((F.max("_sn") >= n).alias("_strat_ok"))
    d = join_stats(df, feasible, keys, "left")
    d = d.withColumn("_stratum", F.when(F.col("_strat_ok"), F.col(stratum).cast("string")).otherwise(F.lit("*")))
    d = kfold(d, n=n, seed=seed, keys=keys + ["_stratum"], row_id=row_id, out=out, rep=rep,
              salt_chars=salt_chars)
    return d.drop("_stratum", "_strat_ok")


def repeated_folds(df: DataFrame, repeats: int, n: int = 5, seed: int = 42, keys=("environment",),
                   stratum: str | None = None, row_id: str = "row_id") -> DataFrame:
    """``repeats`` independent fold assignments (seed + rep), one row per (row, rep)."""
    d = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    seed_col = (F.lit(seed) + F.col("rep")).cast("string")
    d = d.withColumn("_hk", F.md5(F.concat(seed_col, F.lit("|0|"), F.col(row_id).cast("string"))))
    keys = list(keys) + ["rep"]
    if stratum:
        sizes = d.groupBy(*keys, stratum).agg(F.count(F.lit(1)).alias("_sn"))
        feasible = sizes.groupBy(*keys).agg((F.max("_sn") >= n).alias("_ok"))
        d = join_stats(d, feasible, keys, "left").withColumn(
            "_st", F.when(F.col("_ok"), F.col(stratum).cast("string")).otherwise(F.lit("*"))).drop("_ok")
        keys = keys + ["_st"]
    d = salted_row_number(d, keys, "_hk", row_id, out="_rn")
    return d.withColumn("fold", ((F.col("_rn") - 1) % n).cast("int")).drop("_hk", "_rn", "_st")


def leave_one_environment_out(df: DataFrame, env: str = "environment") -> DataFrame:
    """Each environment is one held-out fold of the pooled table (``fold`` =
    environment name).  Training rows of fold e are the rows with ``env <> e``; no rows
    are copied -- additive statistics are ``total - fold``."""
    return df.withColumn("test_env", F.col(env))


def loeo_sizes(df: DataFrame, env: str = "environment") -> DataFrame:
    """Per held-out environment: test and train row counts."""
    from pyspark.sql import Window
    per = df.groupBy(env).agg(F.count(F.lit(1)).alias("n_test"))  # one row per environment
    total = F.sum("n_test").over(Window.partitionBy())
    return per.select(F.col(env).alias("test_env"), "n_test", (total - F.col("n_test")).alias("n_train"))
