"""Every registered query with an oracle statement must equal DuckDB on sf0.001; the others must hold their shape."""

import pytest

from strata.plans.catalog import load_all
from tests.conftest import SF_SMALL
from tests.oracle import compare

REG = load_all()
SQL_NAMES = sorted(n for n, q in REG.items() if q.sql)
# Learner queries are tested in test_learners.py.
LEARNERS = {"M05_decision_tree", "M06_random_forest", "M07_extra_trees", "M08_gradient_boosting", "M09_early_stopping",
            "M10_adaboost_r2", "M12_kernel_regression_rbf", "M13_neural_ordinal", "B04_blend_gbt", "M16_baseline_models",
            "B05_stacked_run", "L06_loeo_metrics", "R04_permutation_importance_learners"}
ROWS_NAMES = sorted(n for n, q in REG.items() if not q.sql and n not in LEARNERS)


@pytest.mark.parametrize("name", SQL_NAMES)
def test_query_matches_oracle(spark, duck, name):
    ok, msg = compare(REG[name].fn(spark, SF_SMALL), duck, REG[name].sql)
    assert ok, msg


@pytest.mark.parametrize("name", ROWS_NAMES)
def test_rows_only_query_runs(spark, name):
    df = REG[name].fn(spark, SF_SMALL)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    assert len({tuple(map(str, r)) for r in rows}) == len(rows)  # no row twice
