"""Robust kernel regression on random Fourier features (survey ID M12, re-aimed).

A Gaussian kernel is approximated by ``sqrt(2/D) cos(x'omega + phase)`` with omega ~ N(0, 2 gamma);
on these features the sum of Huber losses plus ``alpha/2 |w|^2`` is minimised by iteratively
reweighted least squares.  A round is one scan: every task weighs its training rows by
``min(1, delta / |residual|)`` under its contexts' last weights and adds up the weighted Gram sums
and the loss; D^2 numbers a context are shuffled, never a row.  Contexts whose loss has settled
leave the next scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from . import grams
from .prep import FOLD_CTX


@dataclass(frozen=True)
class Fourier:
    """Features [1, sqrt(2/D) cos(x omega + phase)] of design rows [1, x]."""

    omega: np.ndarray
    phase: np.ndarray

    @classmethod
    def of(cls, width: int, size: int = 64, gamma: float | None = None, seed: int = 42) -> "Fourier":
        """``size`` features of ``width`` design columns; gamma defaults to 1 / width."""
        rng = np.random.default_rng(seed)
        gamma = 1.0 / max(width, 1) if gamma is None else gamma
        return cls(rng.normal(0.0, np.sqrt(2.0 * gamma), (width, size)), rng.uniform(0.0, 2.0 * np.pi, size))

    def __call__(self, z: np.ndarray) -> np.ndarray:
        return np.column_stack([z[:, :1], np.sqrt(2.0 / len(self.phase)) * np.cos(z[:, 1:] @ self.omega + self.phase)])


def weighted_sums(df: DataFrame, contexts: grams.Contexts, features: Fourier, predictors: DataFrame, delta: float) -> DataFrame:
    """(env, k, g): weighted sums of Z' Z, Z = [features, y], over the training rows of every context in ``predictors``, then their Huber loss."""
    def step(state, env, t, batch, num, cats):
        fold, y = batch.column("fold").to_numpy(), batch.column("y").to_numpy()
        for k in t.of:
            own = np.flatnonzero(fold != k)
            if len(own):
                phi = features(t.design(k, num[own], [c[own] for c in cats]))
                size = np.abs(y[own] - phi @ t.predictors(k)[1][:, 0])
                weight = delta / np.maximum(size, delta)
                loss = np.where(size <= delta, size * size / 2, delta * (size - delta / 2)).sum()
                z = np.column_stack([phi, y[own]])
                state[env, k] = state.get((env, k), 0) + np.append((z.T @ (z * weight[:, None])).ravel(), loss)

    parts = grams.scan(df, contexts, step, "env string, k int, g array<double>", finish=grams._keyed, more=grams.listed(predictors))
    return grams.summed(parts, ["env", "k"], "g")


def fit(df: DataFrame, contexts: grams.Contexts, features: Fourier, alpha: float = 1.0, delta: float = 1.0, tol: float = 1e-6, rounds: int = 100,
        name: str = "rbf_huber") -> DataFrame:
    """(env, k, name, w) of every context with training rows; raises when a context has not settled after ``rounds``.

    A round never raises the objective; a context is settled once it falls by at most ``tol`` of itself.
    """
    def solved(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                g, w = grams.square(r["g"][:-1]), np.array(r["w"])
                objective = r["g"][-1] + alpha / 2 * (w[1:] @ w[1:])
                a = g[:-1, :-1] + alpha * np.diag(np.append(0.0, np.ones(len(w) - 1)))
                out.append((r["env"], r["k"], name, np.linalg.solve(a, g[:-1, -1]), objective, r["objective"] is not None and r["objective"] - objective <= tol * objective))
            types = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(list(zip(*out)) or [[]] * 6, types, strict=True)], ["env", "k", "name", "w", "objective", "settled"])

    if not (alpha > 0 and delta > 0):
        raise ValueError("alpha and delta must be positive")
    schema = "env string, k int, name string, w array<double>, objective double, settled boolean"
    zeros = F.array_repeat(F.lit(0.0), len(features.phase) + 1)
    moving = contexts.table.select(F.col(contexts.spec.env).cast("string").alias("env"), F.col(FOLD_CTX).cast("int").alias("k"), F.lit(name).alias("name"), zeros.alias("w"), F.lit(None).cast("double").alias("objective"))
    done = []
    for _ in range(rounds):
        sums = weighted_sums(df, contexts, features, moving.select("env", "k", "name", "w"), delta)
        now = staged(sums.join(moving, ["env", "k"]).select("env", "k", "g", "w", "objective").mapInArrow(solved, schema), "round")
        done.append(now.where("settled").select("env", "k", "name", "w"))
        moving = now.where("not settled").drop("settled")
        if moving.isEmpty():
            return staged(reduce(DataFrame.unionByName, done), "fits")
    raise RuntimeError(f"not settled after {rounds} rounds")


def oof(df: DataFrame, spec, n_folds: int, size: int = 64, alpha: float = 1.0, delta: float = 1.0) -> DataFrame:
    """(row_id, env, fold, model, y_true, y_pred) of held-out rows."""
    contexts = grams.fit(df, spec, n_folds)
    features = Fourier.of(len(contexts.columns), size)
    return grams.predict(df, contexts, fit(df, contexts, features, alpha, delta), features=features)
