"""Statistical tests (survey IDs H01-H07).

Row-scale work (pairing, ranking, rank sums) is Spark; each test ends in one
aggregated row, where the tail probability is a column expression (normal) or a
pandas UDF over those few rows (chi-square, Student t).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import join_stats
from ..functions.ranks import rank_counts
from ..functions.tails import PERFECT_R_TOL, chi2_sf_udf, normal_upper_tail_sql, pearson_p_udf


def paired_errors(preds: DataFrame, main: str, env="environment", row_id="row_id", model="model",
                  y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Absolute errors of the main model and of each baseline on the same rows
    (equi-join on (env, row_id) instead of position); a (env, baseline) pair is skipped
    when its row count differs from the main model's."""
    err = F.abs(F.col(y_true) - F.col(y_pred))
    m = preds.where(F.col(model) == main).select(env, row_id, err.alias("err_main"))
    b = preds.where(F.col(model) != main).select(env, row_id, F.col(model).alias("baseline"), err.alias("err_base"))
    nm = m.groupBy(env).agg(F.count(F.lit(1)).alias("_nm"))
    nb = b.groupBy(env, "baseline").agg(F.count(F.lit(1)).alias("_nb"))
    ok = nb.join(nm, env).where(F.col("_nm") == F.col("_nb")).select(env, "baseline")
    return (join_stats(b, ok, [env, "baseline"], "left_semi").join(m, [env, row_id])
            .select(env, "baseline", row_id, "err_main", "err_base",
                    (F.col("err_base") - F.col("err_main")).alias("d")))


def wilcoxon_signed_rank(pairs: DataFrame, keys=("environment", "baseline"), d="d",
                         per_octave=4096) -> DataFrame:
    """One-sided (greater) signed-rank test of d = err_base - err_main.  Zeros are
    dropped; W = rank sum of the positive differences (ties averaged); normal
    approximation with tie correction, no continuity correction.  All |d| <= 1e-8 ->
    W = 0, p = 1.  Ranks come from the distinct |d| counts (no group-wide window)."""
    keys = list(keys)
    flag = pairs.groupBy(*keys).agg((F.max(F.abs(F.col(d))) <= F.lit(1e-8)).alias("_allzero"))
    nz = pairs.where(F.col(d) != 0)
    counts = nz.groupBy(*keys, F.abs(F.col(d)).alias("ad")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(d) > 0).cast("long")).alias("n_pos"))
    ranked = rank_counts(counts, keys, v="ad", n="n", per_octave=per_octave)
    agg = ranked.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n_pos").cast("double") * F.col("avg_rank")).alias("_w"),
        F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("tie_term"))
    j = flag.join(agg, keys, "left")
    n = F.col("n").cast("double")
    z = (F.col("_w") - n * (n + 1) / 4.0) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("tie_term") / 48.0)
    j = j.withColumn("z", F.when(F.col("_allzero"), F.lit(None).cast("double")).otherwise(z))
    j = j.withColumn("_x", F.abs(F.col("z")) / F.sqrt(F.lit(2.0)))
    p = F.expr(normal_upper_tail_sql("z", "_x"))
    return j.select(*keys, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
                    F.when(F.col("_allzero"), F.lit(0.0)).otherwise(F.col("_w")).alias("wilcoxon_stat"),
                    F.coalesce("tie_term", F.lit(0.0)).alias("tie_term"), "z",
                    F.when(F.col("_allzero"), F.lit(1.0)).otherwise(p).alias("p_raw"))


def friedman(errors: DataFrame, env="environment", block="row_id", treatment="model", value="err",
             with_p: bool = False) -> DataFrame:
    """Friedman chi-square, blocks = rows, treatments = models, tie-corrected; null if
    fewer than 2 blocks or 3 treatments.  Only complete blocks take part."""
    # a block in one row: its treatments, their tie-averaged ranks and its tie term, all from arrays
    blocks = errors.groupBy(env, block).agg(F.array_sort(F.collect_list(F.struct(F.col(treatment).alias("t"), F.col(value).alias("v")))).alias("b"))
    blocks = blocks.select(env, F.transform("b", lambda x: x.t).alias("_set"), F.transform("b", lambda x: x.v).alias("_v"))
    below = lambda x: F.size(F.filter("_v", lambda y: y < x))
    equal = lambda x: F.size(F.filter("_v", lambda y: y == x))
    ranked = blocks.select(env, "_set", F.transform("_v", lambda x: below(x) + (equal(x) + 1) / F.lit(2.0)).alias("_r"),
                           F.aggregate("_v", F.lit(0.0), lambda s, x: s + equal(x) * equal(x) - 1).alias("_tie"))
    # blocks with the same treatments add up; only those with all of an environment's treatments count
    cells = ranked.select(env, "_set", F.posexplode(F.concat(F.array("_tie", F.lit(1.0)), "_r")).alias("_at", "_x")).groupBy(env, "_set", "_at").agg(F.sum("_x").alias("_x"))
    sets = cells.groupBy(env, "_set").agg(F.max(F.when(F.col("_at") == 0, F.col("_x"))).alias("ties"), F.max(F.when(F.col("_at") == 1, F.col("_x"))).alias("n_blocks"),
                                          F.sum(F.when(F.col("_at") > 1, F.col("_x") * F.col("_x"))).alias("ssbn"))
    full = sets.groupBy(env).agg(F.array_distinct(F.flatten(F.collect_list("_set"))).alias("_all"), F.collect_list(F.struct("_set", "ties", "n_blocks", "ssbn")).alias("_sets"))
    own = F.try_element_at(F.filter("_sets", lambda x: (F.size(x["_set"]) == F.size("_all")) & (F.size(F.array_distinct(x["_set"])) == F.size("_all"))), F.lit(1))
    j = full.select(env, F.size("_all").alias("k"), own.alias("_own")).select(
        env, "k", *(F.coalesce(F.col(f"_own.{c}"), F.lit(0.0)).alias(c) for c in ("ties", "n_blocks", "ssbn")))
    n, k = F.col("n_blocks").cast("double"), F.col("k").cast("double")
    c = F.lit(1.0) - F.col("ties") / (k * (k * k - 1) * n)
    chi = (F.lit(12.0) / (k * n * (k + 1)) * F.col("ssbn") - 3 * n * (k + 1)) / c
    out = j.select(env, F.col("n_blocks").cast("bigint").alias("n_blocks"), F.col("k").cast("bigint").alias("k"),
                   F.when((F.col("n_blocks") < 2) | (F.col("k") < 3), F.lit(None).cast("double"))
                   .otherwise(chi).alias("friedman_chi2"))
    if with_p:
        out = out.withColumn("friedman_p", chi2_sf_udf()(F.col("friedman_chi2"), (F.col("k") - 1).cast("double")))
    return out


def holm_adjust(pv: DataFrame, keys=("environment",), test="baseline", p="p_raw", out="p_holm") -> DataFrame:
    """Holm step-down adjustment min((m - i) p_(i), 1) with running maximum."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col(p), F.col(test))
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    d = pv.withColumn("_i", F.row_number().over(w) - 1).withColumn("_m", m)
    d = d.withColumn("_adj", F.least((F.col("_m") - F.col("_i")).cast("double") * F.col(p), F.lit(1.0)))
    run = Window.partitionBy(*keys).orderBy(F.col(p), F.col(test)).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(out, F.max("_adj").over(run)).drop("_i", "_m", "_adj")


def holm_reference(pv: DataFrame, keys=("environment",), test="baseline", p="p_raw", alpha=0.05) -> DataFrame:
    """The largest Holm threshold alpha/(m - i) met by its sorted p-value, else 0."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col(p), F.col(test))
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    d = pv.withColumn("_thr", F.lit(alpha) / (m - (F.row_number().over(w) - 1)).cast("double"))
    return d.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(p) <= F.col("_thr"), F.col("_thr"))),
                                           F.lit(0.0)).alias("holm_reference"))


def pearson_tests(corr: DataFrame, with_p: bool = True) -> DataFrame:
    """T statistic (and two-sided p) of each correlation; |r| >= 1 - 1e-12 (perfect
    correlation, e.g. the diagonal) -> t null, p 0."""
    t = F.when(F.abs("r") >= 1.0 - PERFECT_R_TOL, F.lit(None).cast("double")).otherwise(
        F.col("r") * F.sqrt((F.col("n") - 2).cast("double") / (F.lit(1.0) - F.col("r") * F.col("r"))))
    out = corr.withColumn("t", t)
    if with_p:
        out = out.withColumn("p", pearson_p_udf()(F.col("r"), F.col("n").cast("double")))
    return out


def fdr_mask(pv: DataFrame, keys, order_cols, p="p", alpha=0.05, step_up: bool = False) -> DataFrame:
    """Benjamini-Hochberg style mask.  Default (reference form): elementwise
    p <= rank/m * alpha; ``step_up`` gives the classical step-up rule."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col(p), *[F.col(c) for c in order_cols])
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    d = pv.withColumn("_thr", F.row_number().over(w).cast("double") / m.cast("double") * F.lit(alpha))
    d = d.withColumn("significant", F.col(p) <= F.col("_thr"))
    if step_up:
        big = F.max(F.when(F.col("significant"), F.col(p))).over(Window.partitionBy(*keys))
        d = d.withColumn("significant", F.coalesce(F.col(p) <= big, F.lit(False)))
    return d.withColumnRenamed("_thr", "threshold")
