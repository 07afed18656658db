"""Preprocessing statistics and their application (survey IDs T01-T09).

Data stay long: ``(row_id, env, fold, feature, value)``.  A *context* is what a
preprocessor is fitted on: ``(env, k)`` = the training rows of fold k (all rows with
``fold <> k``) in fold scope, or ``(env,)`` in global scope.

Fold scope never copies raw rows: the distinct-value counts per (env, fold, feature)
are computed once and each count row is credited to the K-1 contexts it trains, so
the work is (K-1) x the *distinct-value* table.  The three dependent statistics
(median -> quartiles of the imputed column -> median / IQR of the capped column) are
evaluated on that count table: imputation adds one (median, #nulls) entry and capping
maps each distinct value through ``clip``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import join_stats, stats_table
from ..functions.quantiles import monotone_bucket, pivot_quantiles, quantiles_from_counts
from ..session import staged
from ..spec import FeatureSpec
from .clean import clean_strings, numeric_if_all_parse

FOLD_CTX = "k"


def _q(name):
    return "`" + name.replace("`", "``") + "`"


def long_numeric(df: DataFrame, spec: FeatureSpec, extra=("fold",)) -> DataFrame:
    keys = [spec.row_id, spec.env] + [c for c in extra if c in df.columns]
    return df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(_q(c)).cast("double").alias("value"))
        for c in spec.num_cols])).alias("kv")).select(*keys, "kv.feature", "kv.value")


def long_categorical(df: DataFrame, spec: FeatureSpec, extra=("fold",)) -> DataFrame:
    keys = [spec.row_id, spec.env] + [c for c in extra if c in df.columns]
    return df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(_q(c)).cast("string").alias("level"))
        for c in spec.cat_cols])).alias("kv")).select(*keys, "kv.feature", "kv.level")


def context_counts(long: DataFrame, env: str, value: str, n_folds: int | None, fold: str = "fold") -> DataFrame:
    """Distinct-value counts per context ``(env[, k], feature, value) -> n`` (null value
    rows count the missing entries)."""
    if n_folds is None:
        return long.groupBy(env, "feature", value).agg(F.count(F.lit(1)).alias("n"))
    per_fold = long.groupBy(env, fold, "feature", value).agg(F.count(F.lit(1)).alias("n"))
    credited = per_fold.withColumn(
        FOLD_CTX, F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(n_folds - 1)), F.col(fold))))
    return credited.groupBy(env, FOLD_CTX, "feature", value).agg(F.sum("n").alias("n"))


def ctx_keys(env: str, n_folds: int | None):
    return [env, "feature"] if n_folds is None else [env, FOLD_CTX, "feature"]


def fit_median(counts: DataFrame, keys, per_octave=4096) -> DataFrame:
    """T01 statistic: median of the non-null values per context."""
    nonnull = counts.where(F.col("value").isNotNull())
    q = quantiles_from_counts(nonnull, keys, [0.5], v="value", per_octave=per_octave)
    return pivot_quantiles(q, keys, {0.5: "median"})


def _imputed_counts(counts: DataFrame, med: DataFrame, keys) -> DataFrame:
    nonnull = counts.where(F.col("value").isNotNull()).select(*keys, "value", "n")
    nulls = (counts.where(F.col("value").isNull()).join(med, keys)
             .where(F.col("median").isNotNull())
             .select(*keys, F.col("median").alias("value"), "n"))
    return nonnull.unionByName(nulls)


def fit_cap(counts: DataFrame, med: DataFrame, keys, factor=1.5, per_octave=4096) -> DataFrame:
    """T03 statistic: Q1 - 1.5 IQR and Q3 + 1.5 IQR of the *imputed* column."""
    imp = _imputed_counts(counts, med, keys)
    q = pivot_quantiles(quantiles_from_counts(imp, keys, [0.25, 0.75], v="value", per_octave=per_octave),
                        keys, {0.25: "q1", 0.75: "q3"})
    iqr = F.col("q3") - F.col("q1")
    return q.select(*keys, (F.col("q1") - F.lit(factor) * iqr).alias("lower"),
                    (F.col("q3") + F.lit(factor) * iqr).alias("upper"))


def fit_scale(counts: DataFrame, med: DataFrame, cap: DataFrame, keys, per_octave=4096) -> DataFrame:
    """T04 statistic: median and IQR of the *capped* column (IQR 0 -> 1)."""
    imp = _imputed_counts(counts, med, keys).join(cap, keys)
    capped = imp.select(*keys, F.greatest(F.col("lower"), F.least(F.col("upper"), F.col("value"))).alias("value"), "n")
    q = pivot_quantiles(quantiles_from_counts(capped, keys, [0.25, 0.5, 0.75], v="value", per_octave=per_octave),
                        keys, {0.25: "s_q1", 0.5: "center", 0.75: "s_q3"})
    iqr = F.col("s_q3") - F.col("s_q1")
    return q.select(*keys, "center", F.when(iqr == 0, F.lit(1.0)).otherwise(iqr).alias("scale"))


def fit_numeric(long: DataFrame, env: str, n_folds: int | None, per_octave=4096) -> DataFrame:
    """All numeric statistics per context: median, lower, upper, center, scale.

    Imputing puts the missing entries right after the median's lower order statistic, and
    capping is monotone, so a quantile of the imputed or capped column is one of the same order
    statistics of the non-null values, clipped.  All of them are therefore found at once: rows are
    counted by value bucket (a small table), credited to contexts there, and only the buckets that
    hold a wanted rank are read again by value.  ``long`` is scanned twice and never shuffled by
    row; rows that are costly to compute should be written first."""
    keys = ctx_keys(env, n_folds)
    own = [env, "feature"] if n_folds is None else [env, "fold", "feature"]

    def credited(counts, *cols):
        if n_folds is None:
            return counts
        ks = F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(n_folds - 1)), F.col("fold")))
        return counts.withColumn(FOLD_CTX, ks).groupBy(*keys, *cols).agg(F.sum("n").alias("n"))

    rows = long.select(*own, "value", monotone_bucket("value", per_octave).alias("_b"))
    buckets = staged(credited(rows.groupBy(*own, "_b").agg(F.count(F.lit(1)).alias("n")), "_b"), "buckets")
    full = Window.partitionBy(*keys)
    buckets = (buckets.withColumn("_M", F.coalesce(F.sum(F.when(F.col("_b").isNull(), F.col("n"))).over(full), F.lit(0))).where("_b is not null")
               .withColumn("_N", F.sum("n").over(full))
               .withColumn("_before", F.coalesce(F.sum("n").over(full.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    total, missing = F.col("_N"), F.col("_M")
    place = lambda n, p: (n - 1).cast("double") * F.lit(p)
    ends = lambda n, p: (F.floor(place(n, p)).cast("long"), F.ceil(place(n, p)).cast("long"))
    mid = ends(total, 0.5)
    # rank among the non-null values of a rank of the imputed column; null where the median stands
    known = lambda r: F.when(r <= mid[0], r).when(r > mid[0] + missing, r - missing)
    quarters = (0.25, 0.5, 0.75)
    wanted = F.array_compact(F.array_distinct(F.array(*mid, *(known(r) for p in quarters for r in ends(total + missing, p)))))
    inside = F.filter(wanted, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("n")))
    located = small_table(buckets.select(*keys, "_b", "_N", "_M", "_before", F.explode(inside).alias("r")))
    hot = located.select(env, "feature", "_b").distinct()
    values = join_stats(rows, hot, [env, "feature", "_b"]).groupBy(*own, "_b", "value").agg(F.count(F.lit(1)).alias("n"))
    values = credited(values, "_b", "value").join(F.broadcast(located), [*keys, "_b"])
    values = values.withColumn("_cum", F.col("_before") + F.sum("n").over(Window.partitionBy(*keys, "r").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    picked = values.where((F.col("_cum") - F.col("n") <= F.col("r")) & (F.col("r") < F.col("_cum")))
    found = picked.groupBy(*keys).agg(F.first("_N").alias("_N"), F.first("_M").alias("_M"), F.map_from_entries(F.collect_list(F.struct("r", "value"))).alias("_x"))

    def between(n, p, value):
        lo, hi = ends(n, p)
        return F.when(lo == hi, value(lo)).otherwise(value(lo) + (value(hi) - value(lo)) * (place(n, p) - lo.cast("double")))

    at = lambda r: F.element_at("_x", r)
    imputed = lambda r: F.coalesce(at(known(r)), F.col("median"))
    capped = lambda r: F.greatest(F.col("lower"), F.least(F.col("upper"), imputed(r)))
    out = found.withColumn("median", between(total, 0.5, at))
    out = out.withColumns({f"_q{i}": between(total + missing, p, imputed) for i, p in enumerate(quarters)})
    iqr = F.col("_q2") - F.col("_q0")
    out = out.withColumns({"lower": F.col("_q0") - F.lit(1.5) * iqr, "upper": F.col("_q2") + F.lit(1.5) * iqr})
    out = out.withColumns({f"_s{i}": between(total + missing, p, capped) for i, p in enumerate(quarters)})
    spread = F.col("_s2") - F.col("_s0")
    return small_table(out.select(*keys, "median", "lower", "upper", F.col("_s1").alias("center"), F.when(spread == 0, F.lit(1.0)).otherwise(spread).alias("scale")))


def small_table(df: DataFrame) -> DataFrame:
    """Materialise a small statistics table in the shared folder; it cuts the lineage of
    dependent passes, and later joins see its true size."""
    return stats_table(df)


def apply_numeric(long: DataFrame, stats: DataFrame, env: str, n_folds: int | None,
                  ctx_col: str | None = "fold") -> DataFrame:
    """Transform long rows with the statistics of their context.  In fold scope
    ``ctx_col`` names the column holding the context fold of each row (``fold`` =
    validation view: each row transformed by the preprocessor that did not see it)."""
    if n_folds is None:
        j = join_stats(long, stats, [env, "feature"], "left")
    else:
        st = stats.withColumnRenamed(FOLD_CTX, ctx_col)
        j = join_stats(long, st, [env, ctx_col, "feature"], "left")
    imputed = F.coalesce(F.col("value"), F.col("median"))
    capped = F.greatest(F.col("lower"), F.least(F.col("upper"), imputed))
    return j.withColumn("imputed", imputed).withColumn("capped", capped) \
            .withColumn("scaled", (capped - F.col("center")) / F.col("scale"))


def fit_mode(long_cat: DataFrame, env: str, n_folds: int | None) -> DataFrame:
    """T02 statistic: most frequent level per context, ties -> smallest level."""
    keys = ctx_keys(env, n_folds)
    counts = context_counts(long_cat, env, "level", n_folds).where(F.col("level").isNotNull())
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("level"))
    return (counts.withColumn("_r", F.row_number().over(w)).where("_r = 1")
            .select(*keys, F.col("level").alias("mode")))


def fit_levels(long_cat: DataFrame, mode: DataFrame, env: str, n_folds: int | None) -> DataFrame:
    """T05 statistic: the levels present in the imputed training column, with 0-based index."""
    keys = ctx_keys(env, n_folds)
    counts = context_counts(long_cat, env, "level", n_folds).join(mode, keys)
    lv = counts.select(*keys, F.coalesce("level", "mode").alias("level")).distinct()
    w = Window.partitionBy(*keys).orderBy("level")
    return lv.withColumn("level_index", (F.row_number().over(w) - 1).cast("int"))


def one_hot(long_cat: DataFrame, mode: DataFrame, levels: DataFrame, env: str, n_folds: int | None,
            ctx_col: str = "fold") -> DataFrame:
    """T05 apply: one indicator row per (row, training level); unknown level -> all zeros."""
    if n_folds is None:
        jk = [env, "feature"]
        m, lv = mode, levels
    else:
        jk = [env, ctx_col, "feature"]
        m = mode.withColumnRenamed(FOLD_CTX, ctx_col)
        lv = levels.withColumnRenamed(FOLD_CTX, ctx_col)
    rows = join_stats(long_cat, m, jk, "left").withColumn("imputed", F.coalesce("level", "mode"))
    lv = lv.withColumnRenamed("level", "train_level")
    return (join_stats(rows, lv, jk)
            .withColumn("hot", (F.col("imputed") == F.col("train_level")).cast("int"))
            .select(*[c for c in rows.columns if c not in ("mode",)], "train_level", "level_index", "hot"))


def category_codes(df: DataFrame, env: str, cols) -> DataFrame:
    """code = 0-based position of the value among the group's sorted distinct values;
    missing -> -1.  One scan finds the levels of all columns; their table is joined back."""
    pairs = F.array(*[F.struct(F.lit(c).alias("f"), F.col(_q(c)).cast("string").alias("_lv")) for c in cols])
    found = df.select(env, F.explode(pairs).alias("p")).select(env, "p.f", "p._lv").where(F.col("_lv").isNotNull()).distinct()
    codes = stats_table(found.withColumn("_code", (F.dense_rank().over(Window.partitionBy(env, "f").orderBy("_lv")) - 1).cast("int")))
    out = df
    for c in cols:
        own = codes.where(F.col("f") == c).select(env, "_lv", "_code")
        out = (join_stats(out.withColumn("_lv", F.col(_q(c)).cast("string")), own, [env, "_lv"], "left")
               .withColumn(f"{c}_code", F.coalesce("_code", F.lit(-1))).drop("_lv", "_code"))
    return out


def clean_features(df: DataFrame, spec: FeatureSpec) -> tuple[DataFrame, FeatureSpec]:
    """The cleaning step of T08: text-typed numeric columns are cleaned (F01) and become
    numeric where every value parses (F03); the others count as categorical."""
    types = dict(df.dtypes)
    texts = [c for c in spec.num_cols if types[c] == "string"]
    if not texts:
        return df, spec
    out, _ = numeric_if_all_parse(clean_strings(df, texts), texts)
    types = dict(out.dtypes)
    left = [c for c in texts if types[c] == "string"]
    return out, spec.with_features([c for c in spec.num_cols if c not in left], [*spec.cat_cols, *left])


def preprocess_global(df: DataFrame, spec: FeatureSpec, per_octave=4096) -> DataFrame:
    """One context per environment: clean -> impute -> cap -> scale numerics, impute -> code
    categoricals.  Long output ``(row_id, env, feature, original, scaled, level)`` where
    ``original`` is the imputed+capped value (the reference's unscaled copy)."""
    env = spec.env
    df, spec = clean_features(df, spec)
    ln = long_numeric(df, spec, extra=())
    stats = fit_numeric(ln, env, None, per_octave)
    num = apply_numeric(ln, stats, env, None).select(
        spec.row_id, env, "feature", F.col("capped").alias("original"), "scaled",
        F.lit(None).cast("string").alias("level"))
    lc = long_categorical(df, spec, extra=())
    mode = fit_mode(lc, env, None)
    imp = join_stats(lc, mode, [env, "feature"], "left").withColumn("level", F.coalesce("level", "mode"))
    lv = imp.select(env, "feature", "level").distinct()
    lv = lv.withColumn("code", (F.dense_rank().over(Window.partitionBy(env, "feature").orderBy("level")) - 1))
    cat = join_stats(imp, lv, [env, "feature", "level"]).select(
        spec.row_id, env, "feature", F.lit(None).cast("double").alias("original"),
        F.col("code").cast("double").alias("scaled"), "level")
    return num.unionByName(cat)


def align_like_train(df: DataFrame, train_columns, fill=None) -> DataFrame:
    """Add the training columns a frame lacks (null), drop extras, use train order."""
    present = set(df.columns)
    return df.select(*[F.col(_q(c)) if c in present else F.lit(fill).alias(c) for c in train_columns])
