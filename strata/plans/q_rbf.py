"""Robust kernel regression by reweighted Gram sums."""

from __future__ import annotations

from ..operators import metrics, rbf
from ..session import staged
from ..sources.tables import COMFORT_SPEC
from ..spec import DEFAULT
from .catalog import register
from .q_split import placed_folds


@register("M12_rbf_huber")
def q_rbf_huber(spark, sf):
    """M12 re-aimed: random Fourier features, Huber loss; held-out metrics of every environment."""
    oof = staged(rbf.oof(placed_folds(spark, sf), COMFORT_SPEC, DEFAULT.folds), "oof")
    return metrics.regression_metrics(oof, [COMFORT_SPEC.env, "model"])
