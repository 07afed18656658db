"""Feature specification and immutable run configuration.

Every operator receives these explicitly; nothing is read from module globals,
so a changed configuration (ablations, sweeps) can never be half-applied.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class FeatureSpec:
    """Names of the key, group, target and feature columns of a long survey table."""

    row_id: str = "row_id"
    env: str = "environment"
    target: str = "target"
    num_cols: tuple[str, ...] = ()
    cat_cols: tuple[str, ...] = ()

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(self.num_cols) + tuple(self.cat_cols)

    def with_features(self, num_cols=None, cat_cols=None) -> "FeatureSpec":
        return replace(
            self,
            num_cols=tuple(self.num_cols if num_cols is None else num_cols),
            cat_cols=tuple(self.cat_cols if cat_cols is None else cat_cols),
        )


@dataclass(frozen=True)
class Config:
    """Run parameters. Defaults are the reference's documented settings."""

    folds: int = 5
    seed: int = 42
    top_m: int = 7
    tau: float = 0.6
    kmin: int = 3
    kmax: int = 7
    perm_repeats: int = 3
    selection_mode: str = "hybrid"  # none | univariate_only | permutation_only | hybrid
    selection_scope: str = "per_model"  # per_model | global
    hybrid_weights: tuple[float, float] = (0.4, 0.6)
    stratify_bins: int = 7
    cv_repeats: int = 3
    calib_alpha: float = 0.10
    tolerance: float = 0.5
    ridge_alphas: tuple[float, ...] = (0.0, 0.01, 0.1, 1.0, 10.0)
    stacker: str = "nnls"  # ridge | nnls | avg | gbt | auto
    stacker_candidates: tuple[str, ...] = ("ridge", "nnls", "avg", "gbt")
    refit_intercept: bool = False  # quirk Q1: keep NNLS intercept after normalising weights
    knn_k: int = 15
    # Sub-buckets used to split one (possibly hot) group for ranks and quantiles.
    fold_salt_hex: int = 3
    value_buckets: int = 4096
    extra: dict = field(default_factory=dict, hash=False, compare=False)

    def but(self, **kw) -> "Config":
        return replace(self, **kw)


DEFAULT = Config()
