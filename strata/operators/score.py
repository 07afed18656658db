"""Feature scoring and selection (survey IDs R01-R11).

Univariate scores use additive per-fold sums: the training statistics of context k
are the sums over folds j != k (no row is copied per context).  Permutation
importance gives every validation row the features of a partner row: an arithmetic bijection
of one numbering of each group names the partner of each repeat (``permuted_rows``), or every
feature and repeat has a seeded MD5 order of its own (``shuffled_rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import join_stats
from ..functions.quantiles import monotone_bucket
from ..functions.ranks import salted_row_number
from .prep import FOLD_CTX

# Categorical feature names of the survey.
SURVEY_CATEGORICALS = ("Season", "Clothing", "Activity", "Environment")


def _credit(per_fold: DataFrame, n_folds: int, fold="fold") -> DataFrame:
    return per_fold.withColumn(FOLD_CTX, F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(n_folds - 1)), F.col(fold))))


def univariate_r2(df: DataFrame, env: str, fold: str, target: str, num_cols, n_folds: int) -> DataFrame:
    """Squared Pearson r of (feature, target) on the training rows of each context;
    0 with fewer than 8 complete pairs or a constant side.  Sums are shifted by the
    environment mean for conditioning (r is shift invariant)."""
    long = df.select(env, fold, F.col(target).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in num_cols])).alias("kv")) \
        .select(env, fold, "y", "kv.*").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    centre = long.groupBy(env, "feature").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    lc = join_stats(long, centre, [env, "feature"]).select(env, fold, "feature", (F.col("x") - F.col("cx")).alias("x"),
                                                    (F.col("y") - F.col("cy")).alias("y"), F.col("x").alias("rx"),
                                                    F.col("y").alias("ry"))
    per = lc.groupBy(env, fold, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"),
        F.sum(F.col("x") * F.col("y")).alias("sxy"), F.min("rx").alias("minx"), F.max("rx").alias("maxx"),
        F.min("ry").alias("miny"), F.max("ry").alias("maxy"))
    tr = _credit(per, n_folds, fold).groupBy(env, FOLD_CTX, "feature").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")],
        F.min("minx").alias("minx"), F.max("maxx").alias("maxx"), F.min("miny").alias("miny"), F.max("maxy").alias("maxy"))
    n = F.col("n").cast("double")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    vx = n * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = n * F.col("syy") - F.col("sy") * F.col("sy")
    ok = (F.col("n") >= 8) & (F.col("minx") < F.col("maxx")) & (F.col("miny") < F.col("maxy"))
    return tr.select(env, FOLD_CTX, "feature", F.when(ok, cov * cov / (vx * vy)).otherwise(F.lit(0.0)).alias("score"))


def eta_squared(df: DataFrame, env: str, fold: str, target: str, cat_cols, n_folds: int) -> DataFrame:
    """Between-level share of the target's sum of squares; missing level = "nan";
    0 with fewer than 2 levels or no variance."""
    long = df.select(env, fold, F.col(target).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("level"))
        for c in cat_cols])).alias("kv")).select(env, fold, "y", "kv.*").where(F.col("y").isNotNull())
    centre = long.groupBy(env).agg(F.avg("y").alias("cy"))
    lc = join_stats(long, centre, [env]).withColumn("y", F.col("y") - F.col("cy"))
    per = lc.groupBy(env, fold, "feature", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"),
                                                        F.sum(F.col("y") * F.col("y")).alias("ss"))
    tr = _credit(per, n_folds, fold).groupBy(env, FOLD_CTX, "feature", "level").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    tot = tr.groupBy(env, FOLD_CTX, "feature").agg(F.sum("n").alias("t_n"), F.sum("s").alias("t_s"),
                                                   F.sum("ss").alias("t_ss"), F.count(F.lit(1)).alias("levels"))
    j = tr.join(tot, [env, FOLD_CTX, "feature"])
    dev = F.col("s") / F.col("n") - F.col("t_s") / F.col("t_n")
    ssb = j.groupBy(env, FOLD_CTX, "feature").agg(F.sum(F.col("n") * dev * dev).alias("ssb"),
                                                  F.first("t_ss").alias("t_ss"), F.first("t_s").alias("t_s"),
                                                  F.first("t_n").alias("t_n"), F.first("levels").alias("levels"))
    sst = F.col("t_ss") - F.col("t_s") * F.col("t_s") / F.col("t_n")
    return ssb.select(env, FOLD_CTX, "feature", F.when((F.col("levels") >= 2) & (sst > 0), F.col("ssb") / sst)
                      .otherwise(F.lit(0.0)).alias("score"))


def minmax_rank(scores: DataFrame, keys, value="score", out="rank_score") -> DataFrame:
    """(v - min)/(max - min) inside each key group; constant group or non-finite -> 0."""
    w = Window.partitionBy(*keys)
    fin = F.when(F.isnan(value) | F.col(value).isNull(), F.lit(None)).otherwise(F.col(value))
    d = scores.withColumn("_v", fin).withColumn("_mn", F.min("_v").over(w)).withColumn("_mx", F.max("_v").over(w))
    r = F.when(F.col("_v").isNull() | (F.col("_mx") == F.col("_mn")), F.lit(0.0)).otherwise(
        (F.col("_v") - F.col("_mn")) / (F.col("_mx") - F.col("_mn")))
    return d.withColumn(out, r).drop("_v", "_mn", "_mx")


# A prime beyond any row count: its powers have no divisor in common with a count, so i -> power * i + b (mod n) permutes 0 ... n - 1.
PRIME = (1 << 61) - 1


def permutation_steps(n: str, repeats: int, seed: int) -> Column:
    """Array of (a, b): repeat r moves the row at place i of n to (a i + b) mod n."""
    steps, a = [], F.lit(1).cast("long")
    for r in range(repeats):
        a = F.pmod(_times(a, F.pmod(F.lit(PRIME), F.col(n)), n), F.col(n))
        b = F.conv(F.substring(F.md5(F.lit(f"{seed}|{r}")), 1, 8), 16, 10).cast("long")
        steps.append(F.struct(a.alias("a"), F.pmod(b, F.col(n)).alias("b")))
    return F.array(*steps)


def _times(a, b, n: str):
    """a * b for factors below n, in decimals where a long would not hold the product."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.when(F.col(n) < 3_000_000_000, a * b).otherwise(F.pmod(wide(a) * wide(b), wide(F.col(n))).cast("long"))


def permuted_rows(rows: DataFrame, keys, pos: str, own, features, repeats: int = 3, seed: int = 42) -> DataFrame:
    """(keys, rep, own columns, features, <feature>_perm): every row ``repeats`` times, beside the features of another row of its group.

    ``pos`` numbers a group's rows from 0 in any random order.  A row sends its features to the
    place that ``permutation_steps`` gives for each repeat and is joined there with the row of that
    place: no numbering per repeat, and nothing is gathered or aggregated.
    """
    keys = list(keys)
    q = lambda c: F.col(f"`{c}`")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*keys, "_n", permutation_steps("_n", repeats, seed).alias("_steps"))
    sent = join_stats(rows.select(*keys, q(pos).alias("_pos"), *(q(c).alias(f"{c}_perm") for c in features)), sizes, keys)
    sent = sent.select("*", F.posexplode("_steps").alias("rep", "_step"))
    place = F.pmod(_times(F.col("_step.a"), F.col("_pos"), "_n") + F.col("_step.b"), F.col("_n"))
    sent = sent.select(*keys, place.alias("_at"), "rep", *(q(f"{c}_perm") for c in features))
    placed = rows.select(*keys, q(pos).alias("_at"), *map(q, own), *map(q, features))
    return placed.join(sent, [*keys, "_at"]).select(*keys, "rep", *map(q, own), *map(q, features), *(q(f"{c}_perm") for c in features))


# Rows of a group whose shuffle keys share their leading bytes, at most about this many.
SHUFFLE_BUCKET = 50_000


def shuffled_rows(rows: DataFrame, keys, row_id: str, own, num_cols, cat_cols=(), repeats: int = 3, seed: int = 42) -> DataFrame:
    """(keys, rep, own columns, features, <feature>_perm) like ``permuted_rows``, but every feature is shuffled apart in every repeat.

    Row i of a group, by ``row_id``, receives the value of the row at position i in the order of
    ``md5('<seed>|<feature>|<rep>|<row_id>')``: features x repeats numberings of all rows, each of
    which sorts a value with its key; a place's values are brought together and joined with its row.
    """
    keys, features = list(keys), [*num_cols, *cat_cols]
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    lead = 1
    while largest > SHUFFLE_BUCKET * 256**lead:
        lead += 1
    # an order-preserving bucket of the id in its own type
    text = dict(rows.dtypes)[row_id] == "string"
    bucket = F.conv(F.substring(F.hex("_id"), 1, 4), 16, 10).cast("int") if text else monotone_bucket(F.col("_id").cast("double"), 256)
    placed = rows.select(*keys, q(row_id).alias("_id"), F.struct(*map(q, own)).alias("_own"), F.struct(*map(q, features)).alias("_x"))
    placed = salted_row_number(placed, keys, "_id", "_id", out="_at", bucket=bucket)
    none = {"v": F.lit(None).cast("double"), "t": F.lit(None).cast("string")}
    value = {f: none | ({"v": q(f).cast("double")} if f in num_cols else {"t": q(f).cast("string")}) for f in features}
    copies = F.array(*(F.struct(F.lit(i * repeats + r).alias("c"), F.lit(f"{seed}|{f}|{r}|").alias("salt"), *(x.alias(n) for n, x in value[f].items())) for i, f in enumerate(features) for r in range(repeats)))
    sent = rows.select(*keys, q(row_id).alias("_id"), F.explode(copies).alias("_c")).select(*keys, "_id", "_c.c", F.unhex(F.md5(F.concat("_c.salt", F.col("_id").cast("string")))).alias("_pk"), "_c.v", "_c.t")
    sent = salted_row_number(sent, [*keys, "c"], "_pk", "_id", out="_at", bucket=F.hex(F.substring("_pk", 1, lead)))
    # moved to their places before they are aggregated: a partial aggregate would find no two values of a place
    met = sent.select(*keys, "_at", "c", "v", "t").repartition(*keys, "_at").groupBy(*keys, "_at").agg(
        *(F.max(F.when(F.col("c") == i * repeats + r, F.col("v" if f in num_cols else "t"))).alias(f"_{i}_{r}") for i, f in enumerate(features) for r in range(repeats)))
    reps = F.array(*(F.struct(F.lit(r).alias("rep"), *(F.col(f"_{i}_{r}").alias(f"_{i}") for i in range(len(features)))) for r in range(repeats)))
    out = placed.join(met, [*keys, "_at"]).select(*keys, "_own", "_x", F.explode(reps).alias("_r"))
    return out.select(*keys, "_r.rep", *(F.col("_own").getField(c).alias(c) for c in own), *(F.col("_x").getField(c).alias(c) for c in features),
                      *(F.col(f"_r._{i}").alias(f"{f}_perm") for i, f in enumerate(features)))


def permutation_values(valid: DataFrame, row_id: str, keys, features, repeats: int, seed: int) -> DataFrame:
    """Shuffled copies of each feature: (row_id, keys, feature, rep, x, x_perm): ``permuted_rows``
    on one numbering of the rows of each group, in the order of their seeded MD5."""
    keys = list(keys)
    named = valid.select(F.col(row_id), *keys, *(F.col(c).alias(f"f__{f}") for f, c in features.items()))
    hashed = named.withColumn("_pk", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string"))))
    placed = salted_row_number(hashed, keys, "_pk", row_id, out="_place").withColumn("_place", F.col("_place") - 1)
    rows = permuted_rows(placed, keys, "_place", [row_id], [f"f__{f}" for f in features], repeats, seed)
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"f__{f}").alias("x"), F.col(f"f__{f}_perm").alias("x_perm")) for f in features))
    return rows.select(row_id, *keys, "rep", F.explode(pairs).alias("kv")).select(row_id, *keys, "kv.feature", "rep", "kv.x", "kv.x_perm")


def combine_scores(u_rank: DataFrame, p_rank: DataFrame | None, keys, mode: str = "hybrid",
                   weights=(0.4, 0.6)) -> DataFrame | None:
    """None / univariate_only / permutation_only / hybrid over the union of features.
    ``u_rank``: (keys-without-model, feature, u); ``p_rank``: (keys, model, feature, p)."""
    if mode == "none":
        return None
    keys = list(keys)
    models = p_rank.select(*keys, "model").distinct()
    u = u_rank.join(models, keys)  # univariate ranks are shared by every model
    j = u.join(p_rank, keys + ["model", "feature"], "full_outer").fillna(0.0, subset=["u", "p"])
    if mode == "univariate_only":
        c = F.col("u")
    elif mode == "permutation_only":
        c = F.col("p")
    else:
        c = F.lit(weights[0]) * F.col("u") + F.lit(weights[1]) * F.col("p")
    return j.select(*keys, "model", "feature", "u", "p", c.alias("combined"))


def top_m(scores: DataFrame, keys, m: int = 7, value="combined") -> DataFrame:
    """The M best features per key group (ties -> feature name)."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col("feature"))
    return scores.withColumn("pick_rank", F.row_number().over(w)).where(F.col("pick_rank") <= m)


def global_scope(combined: DataFrame, keys, m: int = 7) -> DataFrame:
    """Average the combined score over models, take one common top M, give it to
    every model."""
    keys = list(keys)
    avg = combined.groupBy(*keys, "feature").agg(F.avg("combined").alias("combined"))
    common = top_m(avg, keys, m)
    models = combined.select(*keys, "model").distinct()
    return models.join(common, keys)


def stability_selection(picks: DataFrame, combined: DataFrame, keys, n_folds: int, tau=0.6, kmin=3, kmax=7) -> DataFrame:
    """frequency = folds picked / folds; features with freq >= tau ordered by mean
    combined score, at most kmax; none eligible -> the kmin best by mean score."""
    keys = list(keys)
    freq = picks.groupBy(*keys, "feature").agg((F.count(F.lit(1)) / F.lit(float(n_folds))).alias("freq"))
    mean = combined.groupBy(*keys, "feature").agg(F.avg("combined").alias("mean_score"))
    j = mean.join(freq, keys + ["feature"], "left").fillna(0.0, subset=["freq"])
    j = j.withColumn("_elig", F.col("freq") >= F.lit(tau))
    w_all = Window.partitionBy(*keys)
    j = j.withColumn("_any", F.max(F.col("_elig").cast("int")).over(w_all))
    w_el = Window.partitionBy(*keys, "_elig").orderBy(F.col("mean_score").desc(), F.col("feature"))
    w_any = Window.partitionBy(*keys).orderBy(F.col("mean_score").desc(), F.col("feature"))
    j = j.withColumn("_re", F.row_number().over(w_el)).withColumn("_ra", F.row_number().over(w_any))
    sel = F.when(F.col("_any") == 1, F.col("_elig") & (F.col("_re") <= kmax)).otherwise(F.col("_ra") <= kmin)
    return j.select(*keys, "feature", "freq", "mean_score", sel.alias("selected"))


def selection_report(stab: DataFrame, u_raw: DataFrame, perm: DataFrame, combined: DataFrame, keys,
                     cat_cols=SURVEY_CATEGORICALS) -> DataFrame:
    """Per model and feature: type, mean univariate score, mean permutation drops,
    mean combined score, stability frequency, selected flag and rank (selected first,
    then combined score)."""
    keys = list(keys)
    u = u_raw.groupBy(*keys, "feature").agg(F.avg("score").alias("Univariate_Score"))
    p = perm.groupBy(*keys, "model", "feature").agg(F.avg("dR2").alias("Perm_DeltaR2"),
                                                    F.avg("dMAE").alias("Perm_DeltaMAE"),
                                                    F.avg("dAcc").alias("Perm_DeltaAcc"))
    c = combined.groupBy(*keys, "model", "feature").agg(F.avg("combined").alias("Combined_Score"))
    r = (stab.join(c, keys + ["model", "feature"], "left").join(u, keys + ["feature"], "left")
         .join(p, keys + ["model", "feature"], "left")
         .fillna(0.0, subset=["Univariate_Score", "Perm_DeltaR2", "Perm_DeltaMAE", "Perm_DeltaAcc", "Combined_Score"]))
    r = r.withColumn("Type", F.when(F.col("feature").isin(*cat_cols), "categorical").otherwise("numeric"))
    w = Window.partitionBy(*keys, "model").orderBy(F.col("selected").desc(), F.col("Combined_Score").desc(),
                                                   F.col("feature"))
    return r.select(*keys, "model", F.col("feature").alias("Feature"), "Type", "Univariate_Score", "Perm_DeltaR2",
                    "Perm_DeltaMAE", "Perm_DeltaAcc", "Combined_Score", F.col("freq").alias("Stability_Freq"),
                    F.col("selected").alias("Selected"), F.row_number().over(w).cast("bigint").alias("Rank"))


def feature_stability(freqs: DataFrame, keys, top_k: int = 20, named: DataFrame | None = None) -> DataFrame:
    """Frequency summed over models per feature, the top k.  ``named`` holds reports
    (keys, model, feature) that only list names: each listed feature counts 1."""
    keys = list(keys)
    all_freqs = freqs.select(*keys, "feature", "freq")
    if named is not None:
        all_freqs = all_freqs.unionByName(named.select(*keys, "feature", F.lit(1.0).alias("freq")))
    s = all_freqs.groupBy(*keys, "feature").agg(F.sum("freq").alias("freq_sum"))
    w = Window.partitionBy(*keys).orderBy(F.col("freq_sum").desc(), F.col("feature"))
    return s.withColumn("stability_rank", F.row_number().over(w).cast("bigint")).where(F.col("stability_rank") <= top_k)


def selected_union(stab: DataFrame, keys) -> DataFrame:
    """Features selected by at least one model."""
    return stab.where(F.col("selected")).select(*keys, "feature").distinct()
