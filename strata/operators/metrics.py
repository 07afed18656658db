"""Metrics and residual analysis (survey IDs V01-V17), grouped by any key set.

Regression metrics are one ``groupBy().agg``.  Ordinal metrics (exact accuracy, macro
F1, Cohen's kappa, quadratic kappa, Kendall's tau-b) are computed from the class
contingency table -- at most 7 x 7 cells per group whatever the row count -- so no
row pairs are ever formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import join_stats, stats_table
from ..functions.columns import classify3, clip, to_class
from ..functions.quantiles import pivot_quantiles, quantiles_from_counts, value_counts

# Metric names and which are better when lower.
REG_METRICS = ("RMSE", "MAE", "R2", "Accuracy", "Residual_STD", "MBE")
ORD_METRICS = ("Accuracy_exact", "F1_macro", "Kappa", "Kappa_quadratic", "Kendall_tau_b")
LABELS3 = ("Cool", "Neutral", "Warm")


def regression_metrics(df: DataFrame, keys, y_true="y_true", y_pred="y_pred", tol=0.5) -> DataFrame:
    """V01 (+V02, V03): RMSE, MAE, R2 (null when var(y) < 1e-12), tolerance accuracy,
    residual population sd, MBE = mean(true - pred)."""
    e = F.col(y_true) - F.col(y_pred)
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(e * e).alias("_mse"),
        F.avg(F.abs(e)).alias("MAE"),
        F.sum(e * e).alias("_sse"),
        F.var_pop(y_true).alias("_vy"),
        F.avg((F.abs(e) <= F.lit(tol)).cast("double")).alias("Accuracy"),
        F.stddev_pop(e).alias("Residual_STD"),
        F.avg(e).alias("MBE"),
    )
    r2 = F.when(F.col("_vy") < F.lit(1e-12), F.lit(None).cast("double")).otherwise(
        F.lit(1.0) - F.col("_sse") / (F.col("_vy") * F.col("_n")))
    return g.select(*keys, F.sqrt("_mse").alias("RMSE"), "MAE", r2.alias("R2"),
                    F.coalesce("Accuracy", F.lit(0.0)).alias("Accuracy"), "Residual_STD", "MBE")


def tolerance_accuracy(df: DataFrame, keys, y_true="y_true", y_pred="y_pred", tol=0.5) -> DataFrame:
    """Share of |true - pred| <= tol; empty group -> 0."""
    hit = (F.abs(F.col(y_true) - F.col(y_pred)) <= F.lit(tol)).cast("double")
    return df.groupBy(*keys).agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("Accuracy"))


def constant_safe_r2(df: DataFrame, keys, y_true="y_true", y_pred="y_pred") -> DataFrame:
    """R2, null (undefined) when the target variance is below 1e-12."""
    e = F.col(y_true) - F.col(y_pred)
    g = df.groupBy(*keys).agg(F.sum(e * e).alias("_sse"), F.var_pop(y_true).alias("_vy"),
                              F.count(F.lit(1)).alias("_n"))
    return g.select(*keys, F.when(F.col("_vy") < 1e-12, F.lit(None).cast("double"))
                    .otherwise(F.lit(1.0) - F.col("_sse") / (F.col("_vy") * F.col("_n"))).alias("R2"))


def contingency(df: DataFrame, keys, y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Class contingency ``(keys, tc, pc, cnt)`` on F12 classes (clip + half-even round)."""
    return (df.select(*keys, to_class(y_true).alias("tc"), to_class(y_pred).alias("pc"))
            .groupBy(*keys, "tc", "pc").agg(F.count(F.lit(1)).alias("cnt")))


def ordinal_metrics(df: DataFrame, keys, y_true="y_true", y_pred="y_pred", cont: DataFrame | None = None) -> DataFrame:
    """V04-V08 from the contingency table; ``cont`` gives a written one."""
    keys = list(keys)
    ct = cont if cont is not None else stats_table(contingency(df, keys, y_true, y_pred))
    tot = ct.groupBy(*keys).agg(F.sum("cnt").cast("double").alias("n"),
                                F.sum(F.when(F.col("tc") == F.col("pc"), F.col("cnt")).otherwise(0))
                                .cast("double").alias("diag"))
    tm = ct.groupBy(*keys, F.col("tc").alias("c")).agg(F.sum("cnt").cast("double").alias("t_n"))
    pm = ct.groupBy(*keys, F.col("pc").alias("c")).agg(F.sum("cnt").cast("double").alias("p_n"))
    tp = ct.where(F.col("tc") == F.col("pc")).select(*keys, F.col("tc").alias("c"),
                                                      F.col("cnt").cast("double").alias("tp"))
    marg = (tm.join(pm, keys + ["c"], "full_outer").join(tp, keys + ["c"], "left")
            .fillna(0.0, subset=["t_n", "p_n", "tp"]))
    marg = marg.withColumn("idx", (F.dense_rank().over(Window.partitionBy(*keys).orderBy("c")) - 1).cast("double"))
    ms = marg.groupBy(*keys).agg(
        F.avg(F.lit(2.0) * F.col("tp") / (F.col("t_n") + F.col("p_n"))).alias("F1_macro"),
        F.sum(F.col("t_n") * F.col("p_n")).alias("_tp_sum"),
        F.sum(F.col("t_n") * F.col("idx") * F.col("idx")).alias("_ti2"),
        F.sum(F.col("p_n") * F.col("idx") * F.col("idx")).alias("_pi2"),
        F.sum(F.col("t_n") * F.col("idx")).alias("_ti"),
        F.sum(F.col("p_n") * F.col("idx")).alias("_pi"))
    # Quadratic-weighted disagreement on the class indices.
    idx_t = marg.select(*keys, F.col("c").alias("tc"), F.col("idx").alias("it"))
    idx_p = marg.select(*keys, F.col("c").alias("pc"), F.col("idx").alias("ip"))
    qobs = (ct.join(idx_t, keys + ["tc"]).join(idx_p, keys + ["pc"])
            .groupBy(*keys).agg(F.sum(F.col("cnt") * (F.col("it") - F.col("ip")) * (F.col("it") - F.col("ip")))
                                .alias("_qobs")))
    # Kendall: concordant / discordant cell pairs (<= 49 x 49 per group).
    a = ct.select(*keys, F.col("tc").alias("a_t"), F.col("pc").alias("a_p"), F.col("cnt").alias("a_n"))
    b = ct.select(*keys, F.col("tc").alias("b_t"), F.col("pc").alias("b_p"), F.col("cnt").alias("b_n"))
    pairs = (a.join(b, keys).where(F.col("a_t") < F.col("b_t"))
             .groupBy(*keys).agg(
                 F.sum(F.when(F.col("a_p") < F.col("b_p"), F.col("a_n") * F.col("b_n")).otherwise(0)).cast("double").alias("_con"),
                 F.sum(F.when(F.col("a_p") > F.col("b_p"), F.col("a_n") * F.col("b_n")).otherwise(0)).cast("double").alias("_dis")))
    ties = marg.groupBy(*keys).agg(
        F.sum(F.col("t_n") * (F.col("t_n") - 1) / 2).alias("_n1"),
        F.sum(F.col("p_n") * (F.col("p_n") - 1) / 2).alias("_n2"))
    j = (tot.join(ms, keys).join(qobs, keys).join(ties, keys).join(pairs, keys, "left")
         .fillna(0.0, subset=["_con", "_dis"]))
    n = F.col("n")
    pe_den = n - F.col("_tp_sum") / n
    kappa = F.when(pe_den == 0, F.lit(None).cast("double")).otherwise(F.lit(1.0) - (n - F.col("diag")) / pe_den)
    qexp = F.col("_ti2") + F.col("_pi2") - F.lit(2.0) * F.col("_ti") * F.col("_pi") / n
    kq = F.when(qexp == 0, F.lit(None).cast("double")).otherwise(F.lit(1.0) - F.col("_qobs") / qexp)
    n0 = n * (n - 1) / 2
    den = (n0 - F.col("_n1")) * (n0 - F.col("_n2"))
    tau = F.when(den <= 0, F.lit(None).cast("double")).otherwise((F.col("_con") - F.col("_dis")) / F.sqrt(den))
    return j.select(*keys, (F.col("diag") / n).alias("Accuracy_exact"), "F1_macro",
                    kappa.alias("Kappa"), kq.alias("Kappa_quadratic"), tau.alias("Kendall_tau_b"))


def evaluate(df: DataFrame, keys, y_true="y_true", y_pred="y_pred", tol=0.5) -> DataFrame:
    """The full metric row of the reference (regression + ordinal)."""
    return regression_metrics(df, keys, y_true, y_pred, tol).join(
        ordinal_metrics(df, keys, y_true, y_pred), list(keys))


def confusion3(df: DataFrame, keys, y_true="y_true", y_pred="y_pred") -> DataFrame:
    """3-class (Cool / Neutral / Warm) counts for every cell, zero cells kept, with
    the row share (row sum floored at 1)."""
    keys = list(keys)
    lab = df.select(*keys, classify3(y_true).alias("true_label"), classify3(y_pred).alias("pred_label"))
    counts = lab.groupBy(*keys, "true_label", "pred_label").agg(F.count(F.lit(1)).alias("count"))
    grid = F.array(*[F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("pred_label"))
                     for t in LABELS3 for p in LABELS3])
    cells = lab.select(*keys).distinct().select(*keys, F.explode(grid).alias("g")).select(*keys, "g.*")
    out = cells.join(counts, keys + ["true_label", "pred_label"], "left").fillna(0, subset=["count"])
    row_sum = F.sum("count").over(Window.partitionBy(*keys, "true_label"))
    return out.withColumn("count", F.col("count").cast("bigint")) \
              .withColumn("row_share", F.col("count") / F.greatest(row_sum, F.lit(1)).cast("double"))


def macro_prf(conf: DataFrame, keys) -> DataFrame:
    """Macro precision / recall / F1 over the classes present in truth or prediction."""
    keys = list(keys)
    rows = conf.groupBy(*keys, F.col("true_label").alias("c")).agg(F.sum("count").cast("double").alias("row_n"))
    cols = conf.groupBy(*keys, F.col("pred_label").alias("c")).agg(F.sum("count").cast("double").alias("col_n"))
    tp = conf.where(F.col("true_label") == F.col("pred_label")).select(
        *keys, F.col("true_label").alias("c"), F.col("count").cast("double").alias("tp"))
    per = rows.join(cols, keys + ["c"]).join(tp, keys + ["c"]).where((F.col("row_n") + F.col("col_n")) > 0)
    p = F.when(F.col("col_n") > 0, F.col("tp") / F.col("col_n")).otherwise(0.0)
    r = F.when(F.col("row_n") > 0, F.col("tp") / F.col("row_n")).otherwise(0.0)
    per = per.withColumn("p", p).withColumn("r", r)
    f1 = F.when((F.col("p") + F.col("r")) > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return per.withColumn("f", f1).groupBy(*keys).agg(
        F.avg("p").alias("Precision_macro"), F.avg("r").alias("Recall_macro"), F.avg("f").alias("F1_macro"))


def fold_average(df: DataFrame, keys, fold="fold", y_true="y_true", y_pred="y_pred", tol=0.5, role="role") -> DataFrame:
    """Metrics of each fold's held-out rows averaged over folds, plus the accuracy of
    each fold's model on its own training rows (``role`` 'train'), averaged likewise.
    A fold without training rows has no train accuracy."""
    keys = list(keys)
    per = regression_metrics(df.where(F.col(role) == "valid"), keys + [fold], y_true, y_pred, tol)
    hit = (F.abs(F.col(y_true) - F.col(y_pred)) <= F.lit(tol)).cast("double")
    train = df.where(F.col(role) == "train").groupBy(*keys, fold).agg(F.avg(hit).alias("_train_acc"))
    j = per.join(train, keys + [fold], "left")
    return j.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in REG_METRICS],
                                F.avg("_train_acc").alias("Train_Accuracy"))


def fit_flags(avg: DataFrame, model_col="model", stack_name="stacked_ensemble") -> DataFrame:
    """Under-fit and over-fit warnings as boolean columns."""
    r2_min = F.when(F.col(model_col) == F.lit(stack_name), F.lit(0.3)).otherwise(F.lit(0.2))
    return avg.select("*", (F.col("Accuracy") < 0.4).alias("low_accuracy"),
                      (F.col("R2") < r2_min).alias("low_r2"),
                      ((F.col("Train_Accuracy") - F.col("Accuracy")) > 0.1).alias("overfit"))


def residual_by_class(df: DataFrame, keys, y_true="y_true", y_pred="y_pred", per_octave=4096) -> DataFrame:
    """Per true class -3..3: quartiles of (pred - true) and box whiskers (most extreme
    residual inside 1.5 IQR of the box); empty classes kept with nulls."""
    keys = list(keys)
    r = df.select(*keys, to_class(y_true).alias("true_class"), (F.col(y_pred) - F.col(y_true)).alias("resid"))
    gk = keys + ["true_class"]
    q = pivot_quantiles(quantiles_from_counts(value_counts(r, gk, "resid"), gk, [0.25, 0.5, 0.75],
                                              per_octave=per_octave), gk, {0.25: "q1", 0.5: "median", 0.75: "q3"})
    iqr = F.col("q3") - F.col("q1")
    q = stats_table(q)
    w = (join_stats(r, q, gk).groupBy(*gk).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("resid") >= F.col("q1") - 1.5 * iqr, F.col("resid"))).alias("whisker_lo"),
        F.max(F.when(F.col("resid") <= F.col("q3") + 1.5 * iqr, F.col("resid"))).alias("whisker_hi")))
    grid = r.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("true_class"))
    return (grid.join(q, gk, "left").join(w, gk, "left").fillna(0, subset=["n"])
            .select(*gk, F.col("n").cast("bigint").alias("n"), "q1", "median", "q3", "whisker_lo", "whisker_hi"))


def error_histogram(df: DataFrame, keys, bins=20, y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Equal-width histogram of (true - pred) between min and max (last bin closed)."""
    keys = list(keys)
    e = df.select(*keys, (F.col(y_true) - F.col(y_pred)).alias("err"))
    rng = e.groupBy(*keys).agg(F.min("err").alias("lo"), F.max("err").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("err") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float(bins)))))
    rng = stats_table(rng)
    h = join_stats(e, rng, keys).withColumn("bin", b.cast("int")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = rng.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (grid.join(h, keys + ["bin"], "left").fillna(0, subset=["n"])
            .select(*keys, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"), F.col("n").cast("bigint").alias("n")))


def error_center(df: DataFrame, keys, y_true="y_true", y_pred="y_pred", per_octave=4096) -> DataFrame:
    """V14 companion: mean and median error (true - pred)."""
    keys = list(keys)
    e = df.select(*keys, (F.col(y_true) - F.col(y_pred)).alias("err"))
    med = pivot_quantiles(quantiles_from_counts(value_counts(e, keys, "err"), keys, [0.5], per_octave=per_octave),
                          keys, {0.5: "median_error"})
    return e.groupBy(*keys).agg(F.avg("err").alias("mean_error")).join(med, keys)


def pred_vs_observed(df: DataFrame, keys, y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Finite pairs clipped to [-3, 3] and their RMSE / MAE / R2 labels."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    ok = finite(y_true) & finite(y_pred)
    c = df.where(ok).select(*keys, clip(y_true, -3, 3).alias("obs"), clip(y_pred, -3, 3).alias("pred"))
    m = regression_metrics(c, keys, "obs", "pred")
    return m.select(*keys, "RMSE", "MAE", "R2")


def describe_summary(df: DataFrame, env: str, cols, per_octave=4096) -> DataFrame:
    """Count, mean, sample sd, min, quartiles, max and missing count per column."""
    long = df.select(env, F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                        F.col(c).cast("double").alias("x")) for c in cols])).alias("kv")) \
             .select(env, "kv.column_name", "kv.x")
    keys = [env, "column_name"]
    base = long.groupBy(*keys).agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"),
        F.sum(F.col("x").isNull().cast("long")).alias("missing_values"))
    q = pivot_quantiles(quantiles_from_counts(value_counts(long, keys, "x"), keys, [0.25, 0.5, 0.75],
                                              per_octave=per_octave), keys, {0.25: "p25", 0.5: "p50", 0.75: "p75"})
    return base.join(q, keys, "left")


def correlation_matrix(df: DataFrame, env: str, cols) -> DataFrame:
    """Pairwise-complete Pearson r for every ordered pair, one aggregation."""
    aggs = [F.corr(a, b).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)]
    aggs += [F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n{i}_{j}")
             for i, a in enumerate(cols) for j, b in enumerate(cols)]
    g = df.groupBy(env).agg(*aggs)
    entries = [F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.col(f"c{i}_{j}").alias("r"),
                        F.col(f"n{i}_{j}").alias("n"))
               for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return g.select(env, F.explode(F.array(*entries)).alias("e")).select(env, "e.*")
