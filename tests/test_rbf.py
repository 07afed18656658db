"""Robust kernel regression against a direct solution in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import grams, models, rbf
from strata.plans.q_split import placed_folds
from strata.sources.tables import COMFORT_SPEC as SPEC
from tests.conftest import SF_SMALL

ENV, ALPHA, DELTA = "environment", 1.0, 0.5


def test_features_approximate_the_kernel():
    x = np.random.default_rng(0).normal(size=(40, 3))
    phi = rbf.Fourier.of(3, 20_000, gamma=0.3)(np.column_stack([np.ones(40), x]))[:, 1:]
    exact = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(phi @ phi.T - exact).max() < 0.05


def test_fit_and_predictions_against_numpy(spark):
    rows = placed_folds(spark, SF_SMALL)
    env = rows.agg(F.min(ENV)).first()[0]
    rows = rows.where(F.col(ENV) == env)
    contexts = grams.fit(rows, SPEC, 5)
    features = rbf.Fourier.of(len(contexts.columns), 16)
    fits = rbf.fit(rows, contexts, features, ALPHA, DELTA, tol=1e-7)
    got = {r.k: np.array(r.w) for r in fits.collect()}
    assert sorted(got) == list(range(5))
    held = {r.row_id: r.y_pred for r in grams.predict(rows, contexts, fits, features=features).collect()}
    assert len(held) == rows.count()
    d, xcols = models.design_rows(rows, SPEC, 5, levels=models.categorical_levels(rows, SPEC.cat_cols))
    pdf = d.toPandas()
    for k in (0, 3):
        own = pdf[pdf.k == k]
        phi = features(np.column_stack([np.ones(len(own)), own[xcols].to_numpy(float)]))
        train, y = (own.role == "train").to_numpy(), own.target.to_numpy(float)
        a, b, w = phi[train], y[train], np.zeros(phi.shape[1])
        ridge = ALPHA * np.diag(np.append(0.0, np.ones(len(w) - 1)))

        def objective(w):
            r = np.abs(b - a @ w)
            return np.where(r <= DELTA, r * r / 2, DELTA * (r - DELTA / 2)).sum() + ALPHA / 2 * (w[1:] @ w[1:])

        for _ in range(2000):
            h = DELTA / np.maximum(np.abs(b - a @ w), DELTA)
            w = np.linalg.solve(a.T @ (a * h[:, None]) + ridge, a.T @ (h * b))
        gradient = a.T @ np.clip(b - a @ w, -DELTA, DELTA) - np.append(0.0, ALPHA * w[1:])
        assert np.abs(gradient).max() < 1e-8  # numpy's own solution is the minimum
        assert objective(got[k]) == pytest.approx(objective(w), rel=1e-5)
        assert phi @ got[k] == pytest.approx(phi @ w, abs=0.02)
        assert phi[~train] @ got[k] == pytest.approx([held[i] for i in own.row_id[~train]], abs=1e-9)


def test_rounds_and_parameters(spark):
    rows = placed_folds(spark, SF_SMALL)
    contexts = grams.fit(rows, SPEC, 5)
    features = rbf.Fourier.of(len(contexts.columns), 4)
    with pytest.raises(ValueError):
        rbf.fit(rows, contexts, features, 0.0)
    with pytest.raises(RuntimeError):
        rbf.fit(rows, contexts, features, rounds=1)
