"""Two computed runs: preprocessing on whole environments, averaged weights, and the verdicts from their rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import grams, models
from strata.plans import q_compare as qc
from strata.plans.q_split import placed_folds
from tests.conftest import SF_SMALL


def test_runs_and_verdicts(spark):
    rows = placed_folds(spark, SF_SMALL)
    one = qc.Run("one", per_fold=True, learners=("ridge",))
    whole = qc.contexts_of(rows, qc.PREDICTED, 5).table.collect()
    pdf = rows.toPandas()
    for r in whole:
        own = pdf[pdf.environment == r.environment]
        assert r.num[0] == pytest.approx(np.median(own.f_total.astype(float).dropna()))  # the same on every context
    assert len(whole) == 5 * pdf.environment.nunique()

    oof = qc.executed(rows, [qc.PREDICTED, qc.ADAPTIVE, one]).toPandas()
    assert (oof.groupby("run").row_id.nunique() == len(pdf)).all() and len(oof) == 3 * len(pdf)
    each = grams.oof(rows, qc.COMFORT_SPEC, 5, models.LINEAR_LEARNERS).toPandas()
    of = lambda t: t.groupby("row_id").y_pred.mean().sort_index().to_numpy()
    assert of(oof[oof.run == qc.ADAPTIVE.name]) == pytest.approx(of(each), abs=1e-8)
    assert of(oof[oof.run == "one"]) == pytest.approx(of(each[each.model == "ridge"]), abs=1e-8)

    got = qc.compared(spark.createDataFrame(oof), qc.PREDICTED, qc.ADAPTIVE).where(F.col("metric") == "MAE").collect()
    assert {r.environment for r in got} == set(pdf.environment)
    oof["e"] = (oof.y_true - oof.y_pred).abs()
    mae = oof.groupby(["environment", "run"]).e.mean()
    for r in got:
        a, b = mae[r.environment, qc.PREDICTED.name], mae[r.environment, qc.ADAPTIVE.name]
        assert (r.Predicted_TSV, r.Adaptive_TSV) == pytest.approx((a, b), abs=6e-5)
        assert r.better == ("Adaptive_TSV is Better" if b < a else "Predicted_TSV is Better" if a < b else "No change")
