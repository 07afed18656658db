"""Cases that once gave other data: large and text ids, per-file columns, infinite values, train accuracy, text-typed numbers, plans."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strata.functions.joins import join_stats
from strata.operators import calib, clean, metrics, models, prep, score, shards, split, stack
from strata.plans.catalog import load_all
from strata.session import ensure_checkpoint_dir
from strata.sources import io
from strata.spec import FeatureSpec
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("kind", ["small", "above 2^53", "text"])
def test_permutation_keeps_ids_in_their_type(spark, kind):
    ids = {"small": list(range(200)), "above 2^53": [2**60 + i for i in range(200)], "text": [f"r{i:05d}" for i in range(200)]}[kind]
    t = "string" if kind == "text" else "long"
    df = spark.createDataFrame([(r, "e", 0, float(i)) for i, r in enumerate(ids)], f"row_id {t}, environment string, k int, x double")
    out = score.permutation_values(df, "row_id", ["environment", "k"], {"x": "x", }, 2, 42)
    for rep in (0, 1):
        own = out.where(f"rep = {rep}").toPandas()
        assert sorted(own.row_id) == sorted(ids) and sorted(own.x_perm) == [float(i) for i in range(200)]
    src = score.permutation_values(df, "row_id", ["environment", "k"], {"x": "row_id"}, 1, 42).toPandas()
    assert sorted(src.x_perm) == sorted(ids)


def test_columns_are_chosen_per_file(spark):
    a = spark.createDataFrame([(1, "e", "m", 1.0, None, 5.0)], "row_id long, environment string, model string, Given_Final_TSV double, TSV_Predicted double, TSV_Predicted_raw double")
    b = spark.createDataFrame([(2, "e", "m", 2.0, 3.0)], "row_id long, environment string, model string, `Given vote TSV` double, oof_pred double")
    c = spark.createDataFrame([(3, "e", "m", 4.0, 5.0)], "row_id long, environment string, model string, Actual_TSV double, TSV_pred double")
    rows = {r.row_id: (r.y_true, r.y_pred) for r in io.resolve_columns([a, b, c]).collect()}
    assert rows == {1: (1.0, None), 2: (2.0, 3.0), 3: (4.0, 5.0)}
    with pytest.raises(ValueError):
        io.resolve_columns([a.drop("Given_Final_TSV")])


def test_infinite_pairs_are_masked(spark):
    rows = [("e", 1.0, 1.0), ("e", 2.0, 2.0), ("e", -1.0, -1.0), ("e", float("inf"), 0.0), ("e", 0.0, float("-inf")), ("e", float("nan"), 0.0), ("e", None, 0.0)]
    assert metrics.pred_vs_observed(spark.createDataFrame(rows, "environment string, y_true double, y_pred double"), ["environment"]).first().RMSE == 0


def test_overfitted_tree_raises_the_flag(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "e", k, "valid" if i % 5 == k else "train", float(rng.integers(-3, 4)), float(rng.normal())) for i in range(200) for k in range(5)]
    y = {}
    rows = [(i, e, k, r, y.setdefault(i, t), y.setdefault(("x", i), x)) for i, e, k, r, t, x in rows]
    d = spark.createDataFrame(rows, "row_id long, environment string, k int, role string, target double, x double")
    out = shards.fit_predict(d, ["x"], ["decision_tree"], roles=("train", "valid")).withColumnRenamed("k", "fold")
    flags = metrics.fit_flags(metrics.fold_average(out, ["environment", "model"])).first()
    assert flags.Train_Accuracy == 1.0 and flags.overfit and flags.Accuracy < 0.6


def test_global_preprocessing_cleans_text_numbers(spark):
    spec = FeatureSpec(row_id="row_id", env="environment", target="t", num_cols=("a", "b", "c"), cat_cols=())
    df = spark.createDataFrame([(i, "e", v, float(i), w) for i, (v, w) in enumerate([(" 1 0 ", "x"), ("20", "2"), ("40", "3"), ("30", "x"), ("N/A", None)])],
                               "row_id long, environment string, a string, b double, c string")
    out = prep.preprocess_global(df, spec).toPandas()
    a = out[out.feature == "a"].set_index("row_id").original
    assert a.to_dict() == {0: 10.0, 1: 20.0, 2: 40.0, 3: 30.0, 4: 25.0}
    assert set(out[out.feature == "c"].level) == {"x", "2", "3"}  # stays categorical


def test_solvers_raise_instead_of_returning_early():
    with pytest.raises(ArithmeticError):
        models._coordinate_descent(np.array([[1.0, 0.999999], [0.999999, 1.0]]), np.array([1.0, -1.0]), 1, 0.0, 0.0, max_iter=3)


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(0)
    for _ in range(50):
        p = rng.integers(1, 8)
        x = rng.normal(size=(60, p)) @ rng.normal(size=(p, p))
        y = rng.normal(size=60) + x[:, 0]
        w = stack.nnls_gram(x.T @ x, x.T @ y)
        slope = x.T @ y - x.T @ x @ w
        assert (w >= 0).all() and slope.max() < 1e-7 * np.abs(x.T @ y).max() and abs(slope @ w) < 1e-6 * np.abs(x.T @ y).max()


def test_exclusion_goes_by_letters_and_digits():
    assert all(clean.is_excluded_name(n, "Given Final TSV") for n in ("Sr. No.", "sr no", " SR.NO ", "S.No.", "given_final-tsv"))
    assert not any(clean.is_excluded_name(n, "Given Final TSV") for n in ("Snow", "No", "TSV", "RH"))


def test_statistics_joins_do_not_shuffle_rows(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        rows = spark.range(20_000).select(F.col("id").alias("row_id"), F.concat(F.lit("e"), (F.col("id") % 3).cast("string")).alias("environment"),
                                          F.lit("m").alias("model"), (F.col("id") % 7 - 3).cast("double").alias("y_true"), F.rand(1).alias("y_pred"))
        cal = calib.bias_and_qhat(rows, ["environment", "model"])
        frames = [calib.apply_calibration(rows, cal, ["environment", "model"]), split.target_bins(rows, "y_true"),
                  clean.skip_incomplete_env(rows, "environment", ["y_true"]), clean.sample_weight(rows, "model", "environment")]
        for f in frames:
            f.collect()
            assert "SortMergeJoin" not in f._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_statistics_tables_are_salted(spark, monkeypatch):
    import strata.functions.joins as joins
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    rows = spark.createDataFrame(pd.DataFrame({"k": [1, 1, 1, 2, 3], "v": [1, 2, 3, 4, 5]}))
    stats = spark.createDataFrame(pd.DataFrame({"k": [1, 2], "s": [10, 20]}))
    assert sorted(map(tuple, join_stats(rows, stats, ["k"], "left").select("v", "s").collect())) == [(1, 10), (2, 10), (3, 10), (4, 20), (5, None)]


def test_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_a_stacker_reads_the_order_tables_once(spark, monkeypatch):
    """the wide predictions and the folds come from one scan of the survey view."""
    from strata.sources import tables
    seen, read = [], tables.read
    monkeypatch.setattr(tables, "read", lambda s, d, name: seen.append(name) or read(s, d, name))
    out = load_all()["B02_blend_nnls"].fn(spark, SF_SMALL)
    assert seen.count("lineitem") == 1 and seen.count("orders") == 1
    assert "lineitem" not in "".join(out.inputFiles()) and "orders" not in "".join(out.inputFiles())


def test_both_pools_share_the_survey_view_and_the_folds(spark, monkeypatch):
    """the second pooled run takes over rows, bins, folds and the stacker's folds of the first."""
    from strata.operators import split
    from strata.plans.stacked import StackedRun
    from strata.sources import tables
    seen, read, numbered, number = [], tables.read, [], split.salted_row_number
    monkeypatch.setattr(tables, "read", lambda s, d, name: seen.append(name) or read(s, d, name))
    monkeypatch.setattr(split, "salted_row_number", lambda *a, **k: numbered.append(1) or number(*a, **k))
    monkeypatch.setattr(StackedRun, "__init__", lambda run, rows, spec=None, weight=None, folds=None: run.__dict__.update(rows=rows, folds=folds or rows.selectExpr("row_id", "environment", "0 as rep", "fold")))
    one = StackedRun.of_pool(spark, SF_SMALL, False)
    two = StackedRun.of_pool(spark, SF_SMALL, True, one)
    assert seen.count("lineitem") == 1 and len(numbered) == 1
    cols = ["row_id", "part", "bin", "fold", "place", "weight"]
    assert sorted(map(tuple, one.rows.select(cols).collect())) == sorted(map(tuple, two.rows.select(cols).collect()))
    assert {r[0] for r in two.rows.select("environment").union(two.folds.select("environment")).distinct().collect()} == {"Combined environment-wise"} and len(two.rows.columns) == len(one.rows.columns) + 25
