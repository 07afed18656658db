"""Property tests of the distributed building blocks against brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strata.functions.quantiles import quantiles_from_counts, value_counts
from strata.functions.ranks import rank_counts, salted_row_number
from strata.functions.tails import normal_sf
from strata.operators import calib, split, stats
from strata.sources.tables import comfort
from tests.conftest import SF_SMALL


def _sample(seed=7, n=3000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 else rng.choice(["a", "b"])  # one group holds most rows
        v = rng.choice([round(rng.gauss(0, 5), 1), rng.randint(-3, 3), 0.0, 1e-7 * rng.random()])
        rows.append((i, g, float(v)))
    return rows


@pytest.mark.parametrize("per_octave", [1, 16, 4096])
def test_quantiles_match_numpy(spark, per_octave):
    rows = _sample()
    df = spark.createDataFrame(rows, "id long, g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = quantiles_from_counts(value_counts(df, ["g"], "v"), ["g"], probs, per_octave=per_octave).collect()
    pdf = pd.DataFrame(rows, columns=["id", "g", "v"])
    for r in got:
        ref = np.quantile(pdf[pdf.g == r.g].v.to_numpy(), r.p)
        assert r.q == pytest.approx(ref, rel=1e-12, abs=1e-12)
    assert len(got) == 3 * len(probs)


@pytest.mark.parametrize("per_octave", [1, 4096])
def test_average_ranks_match_pandas(spark, per_octave):
    rows = _sample(seed=3)
    df = spark.createDataFrame(rows, "id long, g string, v double")
    ranked = rank_counts(value_counts(df, ["g"], "v"), ["g"], per_octave=per_octave)
    got = {(r.g, r.v): r.avg_rank for r in ranked.collect()}
    pdf = pd.DataFrame(rows, columns=["id", "g", "v"])
    pdf["r"] = pdf.groupby("g").v.rank(method="average")
    for g, v, r in pdf[["g", "v", "r"]].itertuples(index=False):
        assert got[(g, v)] == r


def test_salted_row_number_equals_window(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("g"))
    df = df.withColumn("hk", F.md5(F.col("row_id").cast("string")))
    a = {r.row_id: r.rn for r in salted_row_number(df, ["g"], "hk", "row_id", salt_chars=2).collect()}
    from pyspark.sql import Window
    w = Window.partitionBy("g").orderBy("hk", "row_id")
    b = {r.row_id: r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert a == b


def test_kfold_partitions_rows_balanced(spark):
    cf = comfort(spark, SF_SMALL)
    f = split.kfold(cf, n=5).select("row_id", "environment", "fold")
    assert f.count() == cf.count() == f.select("row_id").distinct().count()
    sizes = f.groupBy("environment", "fold").count().toPandas()
    spread = sizes.groupby("environment")["count"].agg(lambda s: s.max() - s.min())
    assert (spread <= 1).all()


def test_stratified_folds_balanced_per_stratum(spark):
    b = split.target_bins(comfort(spark, SF_SMALL))
    f = split.stratified_kfold(b, "bin", n=5).toPandas()
    sizes = f.groupby(["environment", "bin", "fold"]).size().reset_index(name="c")
    full = sizes.groupby(["environment", "bin"]).c.agg(lambda s: s.max() - s.min())
    assert (full <= 1).all()


def test_fold_statistics_do_not_see_their_fold(spark):
    from strata.operators import prep
    from strata.sources.tables import COMFORT_SPEC
    cf = split.kfold(comfort(spark, SF_SMALL), n=5)
    ln = prep.long_numeric(cf, COMFORT_SPEC)
    med = prep.fit_median(prep.context_counts(ln, "environment", "value", 5),
                          ["environment", prep.FOLD_CTX, "feature"]).collect()
    pdf = ln.toPandas()
    for r in med[:20]:
        sub = pdf[(pdf.environment == r.environment) & (pdf.feature == r.feature) & (pdf.fold != r.k)].value.dropna()
        assert r.median == pytest.approx(float(np.median(sub)), rel=1e-12)


def test_calibration_centres_residuals(spark):
    df = spark.createDataFrame([(i, "e", float(i % 7 - 3), float(i % 7 - 3) * 0.8 + 0.3) for i in range(700)],
                               "row_id long, environment string, y_true double, y_pred double")
    cal = calib.bias_and_qhat(df, ["environment"], alpha=0.1)
    out = df.join(cal, "environment").select((F.col("y_true") - F.col("y_pred") - F.col("bias")).alias("r"),
                                            "qhat").toPandas()
    assert abs(out.r.mean()) < 1e-9
    coverage = (out.r.abs() <= out.qhat.iloc[0]).mean()
    assert coverage >= 0.9


def test_wilcoxon_against_brute_force(spark):
    rng = random.Random(11)
    d = [round(rng.gauss(0.1, 1), 1) for _ in range(400)]
    df = spark.createDataFrame([("e", "b", i, 0.0, x, x) for i, x in enumerate(d)],
                               "environment string, baseline string, row_id long, err_main double, err_base double, d double")
    r = stats.wilcoxon_signed_rank(df).collect()[0]
    nz = np.array([x for x in d if x != 0])
    ranks = pd.Series(np.abs(nz)).rank(method="average").to_numpy()
    w = ranks[nz > 0].sum()
    n = len(nz)
    _, cnt = np.unique(np.abs(nz), return_counts=True)
    var = n * (n + 1) * (2 * n + 1) / 24.0 - (cnt ** 3 - cnt).sum() / 48.0
    z = (w - n * (n + 1) / 4.0) / math.sqrt(var)
    assert r.wilcoxon_stat == pytest.approx(w)
    assert r.p_raw == pytest.approx(normal_sf(z), rel=1e-12)


def test_monotone_bucket_never_inverts_order(spark):
    from strata.functions.quantiles import monotone_bucket
    vals = sorted({0.0, -0.0, 5e-324, -5e-324, 1e-300, -1e-300, 1e300, -1e300, 1.0, -1.0, 2.0, 4.0, 8.0,
                   2.0 - 1e-15, 4.0 - 1e-15, 1024.0, 1023.9999999999999, -2.0, -2.0000000000000004,
                   0.1, 0.30000000000000004, 3.0, 1e-5, 123456789.0})
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for per_octave in (1, 16, 4096):
        got = sorted(((r.v, r.b) for r in df.select("v", monotone_bucket("v", per_octave).alias("b")).collect()))
        buckets = [b for _, b in got]
        assert buckets == sorted(buckets), per_octave
