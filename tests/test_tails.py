"""Tail probabilities against values published by the reference."""

import math

import duckdb
import pytest

from strata.functions.tails import chi2_sf, normal_sf, normal_upper_tail_sql, pearson_p, t_two_sided


def wilcoxon_p(w, n):
    mn = n * (n + 1) / 4.0
    se = math.sqrt(n * (n + 1) * (2 * n + 1) / 24.0)
    return normal_sf((w - mn) / se)


# (W, n, published raw p) -- stack vs baselines, Classroom n=918, Hostel n=1730
WILCOXON_GOLDENS = [
    (212545.0, 918, 4.194e-01), (233117.0, 918, 2.860e-03), (214678.5, 918, 3.196e-01),
    (191705.0, 918, 9.916e-01), (737411.0, 1730, 7.058e-01), (955813.0, 1730, 1.047e-23),
    (817002.0, 1730, 5.031e-04), (606508.5, 1460, 2.737e-06), (637808.0, 1460, 4.340e-11),
]


@pytest.mark.parametrize("w,n,p", WILCOXON_GOLDENS)
def test_wilcoxon_goldens(w, n, p):
    assert wilcoxon_p(w, n) == pytest.approx(p, rel=2e-3)


def test_friedman_goldens():
    # chi2 printed to 2 decimals, 13 models -> 12 dof
    assert chi2_sf(40.11, 12) == pytest.approx(6.901e-05, rel=5e-3)
    assert chi2_sf(155.67, 12) == pytest.approx(4.006e-27, rel=5e-3)
    assert chi2_sf(147.38, 12) == pytest.approx(1.926e-25, rel=5e-3)


def test_t_and_pearson():
    assert t_two_sided(2.0, 10) == pytest.approx(0.0733880347707, rel=1e-9)
    assert t_two_sided(1.0, 1) == pytest.approx(0.5, rel=1e-12)
    assert pearson_p(1.0, 50) == 0.0
    assert chi2_sf(2.0, 2) == pytest.approx(math.exp(-1.0), rel=1e-12)


def test_sql_normal_tail_matches_erfc():
    zs = [-4.0, -1.0, 0.0, 0.5, 1.7, 2.9, 4.2, 7.5, 11.0]
    sql = (f"SELECT z, {normal_upper_tail_sql('z', 'x')} FROM (SELECT z, abs(z)/sqrt(2.0) AS x FROM (VALUES "
           + ",".join(f"({z}::double)" for z in zs) + ") t(z))")
    for z, p in duckdb.connect().execute(sql).fetchall():
        assert p == pytest.approx(normal_sf(z), rel=1e-13)


def test_sql_normal_tail_in_spark(spark):
    from pyspark.sql import functions as F
    zs = [-2.5, 0.1, 1.96, 3.3, 9.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").withColumn("x", F.abs("z") / F.sqrt(F.lit(2.0)))
    got = df.select("z", F.expr(normal_upper_tail_sql("z", "x")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(normal_sf(r.z), rel=1e-13)
