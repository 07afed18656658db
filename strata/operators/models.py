"""Design rows for learners that need them (M05-M11) and the solvers of the linear family.

Design rows: every survey row appears once per fold context ``k`` (validation when
``fold == k``, training otherwise) with its features transformed by the preprocessor
fitted on that context (T07).  The statistics are joined as one small wide table per
(env, k), so the transform is a projection.  The linear family does without them: see
``grams``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import FeatureSpec
from ..functions.joins import join_stats
from .prep import FOLD_CTX, fit_numeric, long_numeric

FEATURE_PREFIX = "x__"


def _q(c):
    return "`" + c.replace("`", "``") + "`"


def wide_stats(stats: DataFrame, env: str, features) -> DataFrame:
    """(env, k, feature) statistics -> one row per (env, k) with per-feature columns."""
    aggs = []
    for f in features:
        for s in ("median", "lower", "upper", "center", "scale"):
            aggs.append(F.max(F.when(F.col("feature") == f, F.col(s))).alias(f"{s}__{f}"))
    return stats.groupBy(env, FOLD_CTX).agg(*aggs)


def categorical_levels(df: DataFrame, cat_cols) -> dict:
    """Distinct levels per categorical column (column names of the one-hot design; a
    handful of values per column, read once)."""
    if not cat_cols:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(_q(c)).cast("string").alias("l"))
                                         for c in cat_cols])).alias("kv")).select("kv.*").where(F.col("l").isNotNull())
    out = {c: [] for c in cat_cols}
    for r in long.distinct().orderBy("f", "l").collect():
        out[r["f"]].append(r["l"])
    return out


def onehot_stats(df: DataFrame, spec: FeatureSpec, n_folds: int, levels: dict, fold: str = "fold") -> DataFrame:
    """Per (env, k): the training mode of each categorical column (imputation) and a
    0/1 flag per level seen in the imputed training column (T02 + T05 statistics)."""
    from .prep import fit_mode, long_categorical
    env = spec.env
    lc = long_categorical(df, spec, extra=(fold,))
    mode = fit_mode(lc, env, n_folds)
    per_fold = lc.groupBy(env, fold, "feature", "level").agg(F.count(F.lit(1)).alias("n"))
    cred = per_fold.withColumn(FOLD_CTX, F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(n_folds - 1)), F.col(fold))))
    seen = (cred.join(mode, [env, FOLD_CTX, "feature"]).select(env, FOLD_CTX, "feature",
                                                              F.coalesce("level", "mode").alias("level")).distinct())
    aggs = [F.max(F.when(F.col("feature") == f, F.col("mode"))).alias(f"mode__{f}") for f in levels]
    m = mode.groupBy(env, FOLD_CTX).agg(*aggs)
    flags = [F.max(F.when((F.col("feature") == f) & (F.col("level") == lv), F.lit(1.0))).alias(f"seen__{f}={lv}")
             for f, lvs in levels.items() for lv in lvs]
    sv = seen.groupBy(env, FOLD_CTX).agg(*flags)
    return m.join(sv, [env, FOLD_CTX])


def design_rows(df: DataFrame, spec: FeatureSpec, n_folds: int, fold: str = "fold",
                stats: DataFrame | None = None, weight: str | None = None,
                levels: dict | None = None) -> tuple[DataFrame, list[str]]:
    """Rows x contexts with fold-fitted, scaled numeric features ``x__<name>`` and, when
    ``levels`` is given, fold-fitted one-hot columns ``x__<cat>=<level>`` (missing ->
    training mode; a level unseen in training -> all zeros).

    Returns (design, feature column names).  ``role`` is 'valid' when fold == k."""
    env = spec.env
    feats = list(spec.num_cols)
    if stats is None:
        stats = fit_numeric(long_numeric(df, spec), env, n_folds)
    ws = wide_stats(stats, env, feats)
    base_cols = [spec.row_id, env, fold, spec.target] + ([weight] if weight else [])
    rows = df.select(*base_cols, *[F.col(_q(f)).cast("double").alias(f) for f in feats], *[F.col(_q(c)).cast("string").alias(c) for c in levels or ()])
    rows = rows.withColumn(FOLD_CTX, F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    j = join_stats(rows, ws, [env, FOLD_CTX])
    xs = []
    for f in feats:
        imp = F.coalesce(F.col(f), F.col(f"median__{f}"))
        cap = F.greatest(F.col(f"lower__{f}"), F.least(F.col(f"upper__{f}"), imp))
        xs.append(((cap - F.col(f"center__{f}")) / F.col(f"scale__{f}")).alias(FEATURE_PREFIX + f))
    names = [FEATURE_PREFIX + f for f in feats]
    if levels:
        oh = onehot_stats(df, spec, n_folds, levels, fold)
        j = join_stats(j, oh, [env, FOLD_CTX], "left")
        for f, lvs in levels.items():
            imp = F.coalesce(F.col(f), F.col(f"mode__{f}"))
            for lv in lvs:
                hot = (imp == F.lit(lv)) & F.col(_q(f"seen__{f}={lv}")).isNotNull()
                xs.append(F.when(hot, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{FEATURE_PREFIX}{f}={lv}"))
                names.append(f"{FEATURE_PREFIX}{f}={lv}")
    role = F.when(F.col(fold) == F.col(FOLD_CTX), F.lit("valid")).otherwise(F.lit("train"))
    out = j.select(*base_cols, FOLD_CTX, role.alias("role"), *xs)
    return out, names


# ------------------------------------------------------------------------------------
# Gram aggregation and solvers
# ------------------------------------------------------------------------------------

def gram(design: DataFrame, keys, xcols, y: str, weight: str | None = None) -> DataFrame:
    """One row per key: n, sum x, sum y, sum yy, sum x x' (upper triangle), sum x y."""
    w = F.col(weight) if weight else F.lit(1.0)
    aggs = [F.sum(w).alias("g_n"), F.sum(w * F.col(y)).alias("g_y"), F.sum(w * F.col(y) * F.col(y)).alias("g_yy")]
    for i, a in enumerate(xcols):
        aggs.append(F.sum(w * F.col(a)).alias(f"g_x{i}"))
        aggs.append(F.sum(w * F.col(a) * F.col(y)).alias(f"g_xy{i}"))
        for j in range(i, len(xcols)):
            aggs.append(F.sum(w * F.col(a) * F.col(xcols[j])).alias(f"g_xx{i}_{j}"))
    return design.groupBy(*keys).agg(*aggs)


def _unpack(row, p):
    n = row["g_n"]
    sx = np.array([row[f"g_x{i}"] for i in range(p)], dtype=float)
    sxy = np.array([row[f"g_xy{i}"] for i in range(p)], dtype=float)
    sxx = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            sxx[i, j] = sxx[j, i] = row[f"g_xx{i}_{j}"]
    mx, my = sx / n, row["g_y"] / n
    cxx = sxx - n * np.outer(mx, mx)
    cxy = sxy - n * mx * my
    return n, mx, my, cxx, cxy


def _settled(cxx, cxy, n, l1_pen, l2_pen, w):
    """The exact minimum if the signs of ``w`` are its signs, else None: on given signs the
    optimality conditions are linear."""
    on = w != 0
    sign = np.sign(w[on])
    a = cxx[np.ix_(on, on)] + n * l2_pen * np.eye(int(on.sum()))
    sub = np.linalg.lstsq(a, cxy[on] - n * l1_pen * sign, rcond=None)[0]
    if (np.sign(sub) != sign).any():
        return None
    out = np.zeros(len(w))
    out[on] = sub
    slope = cxy - cxx @ out - n * l2_pen * out
    room = 1e-9 * max(1.0, float(np.abs(cxy).max(initial=0.0)))
    off = np.abs(slope[~on]) > n * l1_pen + room
    return None if off.any() or (np.abs(slope[on] - n * l1_pen * sign) > room).any() else out


def _coordinate_descent(cxx, cxy, n, l1_pen, l2_pen, tol=1e-12, max_iter=100000):
    """min 1/(2n)||y - Xw||^2 + l1_pen ||w||_1 + l2_pen/2 ||w||^2 on centred Gram."""
    p = len(cxy)
    w = np.zeros(p)
    for sweep in range(max_iter):
        delta = 0.0
        for j in range(p):
            if cxx[j, j] <= 0:
                continue
            rho = cxy[j] - cxx[j] @ w + cxx[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - n * l1_pen, 0.0) / (cxx[j, j] + n * l2_pen)
            delta = max(delta, abs(new - w[j]))
            w[j] = new
        if delta < tol * max(1.0, float(np.abs(w).max(initial=0.0))):
            return w
        if sweep % 10 == 9 and (exact := _settled(cxx, cxy, n, l1_pen, l2_pen, w)) is not None:
            return exact
    raise ArithmeticError(f"coordinate descent did not converge in {max_iter} sweeps (last step {delta:g})")


def solve_centred(a, b, n, kind: str, alpha: float = 1.0, l1_ratio: float = 0.5):
    """Weights of one learner (ols | ridge | lasso | elasticnet) from centred sums x'x and x'y over n rows."""
    if kind == "ols":
        return np.linalg.lstsq(a, b, rcond=None)[0]
    if kind == "ridge":
        return np.linalg.solve(a + alpha * np.eye(len(b)), b)
    if kind == "lasso":
        return _coordinate_descent(a, b, n, alpha, 0.0)
    if kind == "elasticnet":
        return _coordinate_descent(a, b, n, alpha * l1_ratio, alpha * (1.0 - l1_ratio))
    raise ValueError(kind)


def solve_linear(row, p: int, kind: str, alpha: float = 1.0, l1_ratio: float = 0.5, active=None):
    """Coefficients (intercept, weights) for one Gram row.

    kind: ols | ridge | lasso | elasticnet.  ``active`` restricts the solve to a feature
    subset (other weights 0)."""
    n, mx, my, cxx, cxy = _unpack(row, p)
    idx = np.arange(p) if active is None else np.asarray(sorted(active), dtype=int)
    w = np.zeros(p)
    if len(idx):
        w[idx] = solve_centred(cxx[np.ix_(idx, idx)], cxy[idx], n, kind, alpha, l1_ratio)
    return float(my - mx @ w), w


# The linear learners and their default parameters (reference config).
LINEAR_LEARNERS = {
    "linear_regression": dict(kind="ols"),
    "ridge": dict(kind="ridge", alpha=1.0),
    "lasso": dict(kind="lasso", alpha=0.001),
    "elasticnet": dict(kind="elasticnet", alpha=0.3, l1_ratio=0.5),
}
