"""Model building blocks against numpy brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strata.operators import grams, knn, models, stack
from strata.spec import FeatureSpec

SPEC = FeatureSpec(row_id="row_id", env="environment", target="target", num_cols=("a", "b"))


def _design(spark, rows):
    pdf = pd.DataFrame(rows, columns=["row_id", "environment", "k", "role", "target", "x__a", "x__b"])
    return spark.createDataFrame(pdf).withColumn("k", F.col("k").cast("int"))


def _brute_knn(tr, q, k):
    d = np.sqrt(((tr[["x__a", "x__b"]].to_numpy() - q) ** 2).sum(axis=1))
    order = np.lexsort((tr["row_id"].to_numpy(), d))[:k]
    dd, yy = d[order], tr["target"].to_numpy()[order]
    if (dd == 0).any():
        return yy[dd == 0].mean()
    return (yy / dd).sum() / (1.0 / dd).sum()


def test_knn_exact_with_hot_duplicate_point(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        hot = i % 3 == 0  # a third of the rows sit on one point
        a, b = (0.5, 0.5) if hot else (rng.normal(), rng.normal())
        role = "valid" if i % 5 == 0 else "train"
        rows.append((i, "e", 0, role, float(rng.integers(-3, 4)), float(a), float(b)))
    d = _design(spark, rows)
    got = {r.row_id: r.y_pred for r in knn.knn_predict(d, SPEC, ["x__a", "x__b"], k=15).collect()}
    pdf = pd.DataFrame(rows, columns=["row_id", "environment", "k", "role", "target", "x__a", "x__b"])
    tr, va = pdf[pdf.role == "train"], pdf[pdf.role == "valid"]
    assert len(got) == len(va)
    for _, r in va.iterrows():
        assert got[r.row_id] == pytest.approx(_brute_knn(tr, np.array([r.x__a, r.x__b]), 15), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("kind", ["constant feature", "outlier", "clusters", "few rows"])
def test_knn_over_many_blocks(spark, kind, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 40)
    monkeypatch.setattr(knn, "CHUNK", 16)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(12 if kind == "few rows" else 700):
        a, b = rng.normal(size=2)
        if kind == "constant feature":
            b = 0.0
        if kind == "outlier" and i % 100 == 0:
            a, b = 1e6 * (i + 1), -1e6
        if kind == "clusters":
            a, b = a * 1e-3 + i % 3, b * 1e-3
        rows.append((i, "e", i % 2, "valid" if i % 7 == 0 else "train", float(rng.integers(-3, 4)), float(a), float(b)))
    pdf = pd.DataFrame(rows, columns=["row_id", "environment", "k", "role", "target", "x__a", "x__b"])
    got = {r.row_id: r.y_pred for r in knn.knn_predict(_design(spark, rows), SPEC, ["x__a", "x__b"], k=15).collect()}
    va = pdf[pdf.role == "valid"]
    assert len(got) == len(va)
    for _, r in va.iterrows():
        tr = pdf[(pdf.role == "train") & (pdf.k == r.k)]
        assert got[r.row_id] == pytest.approx(_brute_knn(tr, np.array([r.x__a, r.x__b]), 15), rel=1e-9, abs=1e-12)


def test_knn_descent_tests_few_boxes_and_loses_none(spark, monkeypatch):
    """Boxes tested per query follow the depth of the tree, not its number of blocks."""
    monkeypatch.setattr(knn, "BLOCK", 16)
    keys, tested = ["environment", "k"], {}
    for n in (256, 4096):
        x = np.random.default_rng(n).uniform(size=(n, 2))
        train = spark.createDataFrame([("e", 0, i, p.tolist()) for i, p in enumerate(x)], "environment string, k int, tid long, x array<double>")
        depth = knn._depth(n, 16)
        cuts = knn._cuts(train, knn.stats_table(train.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))), keys)
        placed = knn.staged(knn._place(train, cuts, keys, depth), "test")
        far = 1.0 / np.sqrt(n)
        asked = placed.where("tid < 100").withColumn("far", F.lit(far)).withColumnRenamed("tid", "qid")
        rounds = knn._descend(asked, knn._boxes(placed, keys, 2, depth), keys, depth)
        tested[n] = sum(2 * r.count() for r in rounds[:-1]) / 100 + 2
        found = {(r.qid, r.node) for r in rounds[-1].collect()}
        block = {r.tid: r.block for r in placed.collect()}
        for q in range(100):
            for i in np.flatnonzero(((x - x[q]) ** 2).sum(axis=1) <= far * far):
                assert (q, block[i]) in found
    print(tested)
    assert tested[4096] < 2.5 * tested[256] and tested[4096] < 12 * knn._depth(4096, 16)  # sixteen times the blocks


def _gram_row(spark, x, y):
    pdf = pd.DataFrame({"g": 1, "y": y, **{f"x{i}": x[:, i] for i in range(x.shape[1])}})
    df = spark.createDataFrame(pdf)
    return models.gram(df, ["g"], [f"x{i}" for i in range(x.shape[1])], "y").toPandas().iloc[0]


def test_linear_solvers_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = 1.5 + x @ np.array([0.7, -2.0, 0.1]) + rng.normal(scale=0.3, size=400)
    row = _gram_row(spark, x, y)
    xc, yc = x - x.mean(0), y - y.mean()
    b, w = models.solve_linear(row, 3, "ols")
    assert w == pytest.approx(np.linalg.lstsq(xc, yc, rcond=None)[0], rel=1e-9)
    b, w = models.solve_linear(row, 3, "ridge", alpha=10.0)
    assert w == pytest.approx(np.linalg.solve(xc.T @ xc + 10.0 * np.eye(3), xc.T @ yc), rel=1e-9)
    # elastic net: coordinate-wise optimality of 1/(2n)||r||^2 + a*l1*|w|_1 + a*(1-l1)/2*|w|^2
    a, l1 = 0.3, 0.5
    b, w = models.solve_linear(row, 3, "elasticnet", alpha=a, l1_ratio=l1)
    grad = -(xc.T @ (yc - xc @ w)) / len(y) + a * (1 - l1) * w
    for j in range(3):
        if w[j] != 0:
            assert grad[j] + a * l1 * np.sign(w[j]) == pytest.approx(0.0, abs=1e-8)
        else:
            assert abs(grad[j]) <= a * l1 + 1e-8


def test_nnls_kkt(spark):
    rng = np.random.default_rng(2)
    p = rng.normal(size=(500, 4))
    y = p @ np.array([0.6, 0.0, 0.5, -0.4]) + 0.2 + rng.normal(scale=0.1, size=500)
    pdf = pd.DataFrame({"g": 1, "y_true": y, **{f"p{i}": p[:, i] for i in range(4)}})
    sums = stack._sums(spark.createDataFrame(pdf), ["g"], [f"p{i}" for i in range(4)], "y_true").toPandas().iloc[0]
    n, mx, my, cxx, cxy, _ = stack._moments(sums, 4)
    w = stack.nnls_gram(cxx, cxy)
    grad = cxx @ w - cxy
    assert (w >= 0).all()
    assert np.all(grad[w > 0] == pytest.approx(0.0, abs=1e-7 * n))
    assert np.all(grad[w == 0] >= -1e-7 * n)
    b, wn = stack.fit_nnls(sums, 4)
    assert wn.sum() == pytest.approx(1.0)


def test_gram_ols_on_onehot_design_matches_numpy(spark):
    from strata.operators import split
    from strata.sources.tables import COMFORT_SPEC, comfort
    from tests.conftest import SF_SMALL
    cf = split.kfold(comfort(spark, SF_SMALL), n=5)
    d, xcols = models.design_rows(cf, COMFORT_SPEC, 5, levels=models.categorical_levels(cf, COMFORT_SPEC.cat_cols))
    assert any("=" in c for c in xcols)
    oof = grams.oof(cf, COMFORT_SPEC, 5, {"ols": dict(kind="ols")})
    env = d.select("environment").first()[0]
    pdf = d.where((F.col("environment") == env) & (F.col("k") == 2)).toPandas()
    tr, va = pdf[pdf.role == "train"], pdf[pdf.role == "valid"]
    # one-hot rows of a fitted context sum to 1 per categorical feature (mode imputation)
    for f in COMFORT_SPEC.cat_cols:
        cols = [c for c in xcols if c.startswith(f"x__{f}=")]
        assert (tr[cols].sum(axis=1) == 1.0).all()
    x, y = tr[xcols].to_numpy(), tr["target"].to_numpy()
    w = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0]
    b = y.mean() - x.mean(0) @ w
    want = dict(zip(va["row_id"], b + va[xcols].to_numpy() @ w))
    got = {r.row_id: r.y_pred for r in oof.where((F.col("environment") == env) & (F.col("fold") == 2)).collect()}
    assert set(got) == set(want)
    for k_, v in want.items():
        assert got[k_] == pytest.approx(v, rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("kind", ["spread", "far from zero", "lattice", "copies", "one point is infinite"])
def test_knn_search_of_a_block_computes_few_distances_and_loses_none(kind):
    """pairs beyond a bound of the k-th distance are not computed; ties go to the smaller order."""
    rng = np.random.default_rng(8)
    t, q = rng.normal(size=(1500, 3)), rng.normal(size=(90, 3))
    if kind == "far from zero":
        t, q = t * 1e-4 + 1e7, q * 1e-4 + 1e7
    if kind == "lattice":
        t, q = np.round(t), np.round(q)
    if kind == "copies":
        t[200:] = t[:1300]
    if kind == "one point is infinite":
        t[3, 1] = np.inf
    order, k = rng.permutation(1500).astype(float), 15
    d = np.zeros((90, 1500))
    for j in range(3):
        gap = q[:, j, None] - t[None, :, j]
        d += gap * gap
    d = np.sqrt(d)
    for far in (np.full(90, np.inf), np.sort(d, axis=1)[:, 4]):
        row, point, found = knn._nearest(q, t, order, far, k)
        for i in range(90):
            best = [c for c in np.lexsort((order, d[i]))[:k] if d[i, c] <= far[i]]
            assert point[row == i].tolist() == best and (found[row == i] == d[i, best]).all()
        if kind == "spread":
            assert sum(len(r) for r, _ in knn._candidates(q, t, far, k)) < 90 * 2 * k
