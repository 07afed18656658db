"""Linear models on partition-local sums against numpy on design rows; permutation partners; report sets."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import grams, metrics, models, score
from strata.plans import loeo, variants
from strata.plans.catalog import load_all
from strata.plans.q_split import placed_folds
from strata.sources import io
from strata.sources.tables import COMFORT_SPEC as SPEC
from tests.conftest import SF_SMALL

ENV = "environment"


@pytest.fixture(scope="module")
def folds(spark):
    return placed_folds(spark, SF_SMALL)


@pytest.fixture(scope="module")
def contexts(folds):
    return grams.fit(folds, SPEC, 5)


@pytest.fixture(scope="module")
def design(folds):
    levels = models.categorical_levels(folds, SPEC.cat_cols)
    d, xcols = models.design_rows(folds, SPEC, 5, levels=levels)
    pdf = d.toPandas()
    env = sorted(pdf[ENV].unique())[0]
    return env, pdf[pdf[ENV] == env], xcols


def test_sums_of_a_context(folds, contexts, design):
    env, pdf, xcols = design
    assert [f"x__{c}" for c in contexts.columns] == xcols
    got = {(r.k, r.side): grams.square(r.g) for r in grams.cells(folds, contexts).where(F.col("env") == env).collect()}
    for k in range(5):
        for side, role in ((grams.TRAIN, "train"), (grams.VALID, "valid")):
            own = pdf[(pdf.k == k) & (pdf.role == role)]
            z = np.column_stack([np.ones(len(own)), own[xcols], own.target])
            assert got[k, side] == pytest.approx(z.T @ z, rel=1e-9, abs=1e-6)


def test_contexts_that_are_too_large_to_hand_out_come_with_the_rows(folds, contexts, monkeypatch):
    key = lambda rows: {(r.env, r.k, r.side): r.g for r in rows.collect()}
    want = key(grams.cells(folds, contexts))
    monkeypatch.setattr(grams, "HANDED_OUT", 0)
    got = key(grams.cells(folds, contexts))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_cells_add_up_and_weights_count(folds, contexts):
    whole = {(r.env, r.k, r.side): np.array(r.g) for r in grams.cells(folds, contexts).collect()}
    parts = {}
    for r in grams.cells(folds, contexts, cell=F.col("row_id") % 3, weight=F.lit(2.0)).collect():
        parts[r.env, r.k, r.side] = parts.get((r.env, r.k, r.side), 0) + np.array(r.g)
    assert all(parts[k] == pytest.approx(2 * whole[k]) for k in whole)


def test_score_equals_metrics_of_rows(folds, contexts):
    fits = grams.fits(grams.cells(folds, contexts), models.LINEAR_LEARNERS).withColumn("bias", F.lit(0.25)).withColumn("clipped", F.lit(1))
    got = grams.score(folds, contexts, fits).withColumnRenamed("env", ENV).withColumnRenamed("name", "model").toPandas().set_index([ENV, "model"]).sort_index()
    rows = grams.predict(folds, contexts, fits.drop("bias", "clipped")).withColumn("y_pred", F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.col("y_pred") + 0.25)))
    want = metrics.evaluate(rows, [ENV, "model"]).toPandas().set_index([ENV, "model"]).sort_index()
    for c in (*metrics.REG_METRICS, *metrics.ORD_METRICS):
        assert got[c].to_numpy(float) == pytest.approx(want[c].to_numpy(float), rel=1e-9, abs=1e-9), c


def test_importance_against_numpy(folds, contexts, design):
    env, pdf, xcols = design
    fits = grams.fits(grams.cells(folds, contexts), {"ridge": dict(kind="ridge", alpha=1.0)})
    w = {r.k: np.array(r.w) for r in fits.where(F.col("env") == env).collect()}
    got = {(r.k, r.feature): (r.dR2, r.dMAE, r.dAcc) for r in grams.importance(folds, contexts, fits, "place").where(F.col(ENV) == env).collect()}
    place = {r.row_id: r.place for r in folds.where(F.col(ENV) == env).collect()}
    own = pdf[(pdf.k == 1) & (pdf.role == "valid")].assign(place=lambda p: p.row_id.map(place)).sort_values("place")
    x, y, n = own[xcols].to_numpy(), own.target.to_numpy(), len(own)
    assert list(own.place) == list(range(n))
    base = w[1][0] + x @ w[1][1:]
    r2 = lambda p: 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    for f in SPEC.features:
        cols = [i for i, c in enumerate(xcols) if c[3:].split("=")[0] == f]
        drops = []
        for r in range(3):
            a, b = pow(score.PRIME, r + 1, n), int(hashlib.md5(f"42|{r}".encode()).hexdigest()[:8], 16) % n
            partner = np.empty(n, int)
            partner[[(a * i + b) % n for i in range(n)]] = range(n)
            moved = x.copy()
            moved[:, cols] = x[partner][:, cols]
            p = w[1][0] + moved @ w[1][1:]
            hits = lambda q: (np.abs(y - q) <= 0.5).mean()
            drops.append([max(0, r2(base) - r2(p)), max(0, np.abs(y - p).mean() - np.abs(y - base).mean()), max(0, hits(base) - hits(p))])
        assert got[1, f] == pytest.approx(np.mean(drops, axis=0), rel=1e-7, abs=1e-9)


def test_partners_are_a_permutation_of_each_group(spark):
    rows = spark.range(700).selectExpr("case when id < 1 then 'one' when id < 3 then 'two' else 'many' end as g", "id", "cast(id as double) as x")
    numbered = rows.withColumn("pos", F.expr("case when g = 'one' then 0 when g = 'two' then id - 1 else id - 3 end"))
    out = score.permuted_rows(numbered, ["g"], "pos", ["id"], ["x"], repeats=4).toPandas()
    for (g, _), own in out.groupby(["g", "rep"]):
        assert sorted(own.x) == sorted(own.x_perm) == sorted(own.id) and len(own) == {"one": 1, "two": 2, "many": 697}[g]
    many = out[out.g == "many"]
    assert (many.x != many.x_perm).mean() > 0.9 and many.groupby("id").x_perm.nunique().mean() > 3


def test_ablation_variants_equal_rows_scored_one_by_one(spark, folds):
    grid = load_all()["L09_ablation_grid"].fn(spark, SF_SMALL).toPandas()
    assert grid.groupby("Variant").environment.nunique().eq(5).all() and grid.Variant.nunique() == 96
    base = variants.Base(folds)
    masked = variants.masks(base, variants.select_features(base, [("v", "hybrid", "per_model", 5, 5)]))
    fitted = variants.fit_masks(base, masked.select(ENV, "model", "mask")).withColumnRenamed("model", "name")
    oof = grams.predict(folds, base.contexts, fitted).toPandas()
    want = {}
    for env, e in oof.groupby(ENV):
        sse = {m: ((g.y_true - g.y_pred) ** 2).sum() for m, g in e.groupby("model")}
        best = e[e.model == min(sse, key=lambda m: (round(sse[m], 9), m))]
        want[env] = ((best.y_true - best.y_pred) ** 2).mean() ** 0.5
    got = grid[grid.Variant == "sm_hybrid__sc_per_model__stack_0__cal_0__k5"].set_index(ENV).RMSE
    assert got.to_dict() == pytest.approx(want, abs=2e-6)
    pair = grid[grid.Variant.str.startswith("sm_none__sc_global__stack_1") & grid.Variant.str.endswith("__k7")].pivot(index=ENV, columns="Variant", values="MBE").abs()
    calibrated = [c for c in pair if "__cal_1__" in c][0]
    assert (pair[calibrated] < 0.05).all()


def test_loeo_stack_against_numpy(spark):
    rows, idx, n = loeo.pooled(spark, SF_SMALL)
    ctx = grams.fit(rows, SPEC, n)
    levels = ctx.levels
    d, xcols = models.design_rows(rows, SPEC, n, levels=levels)
    pdf = d.where("k = 2").toPandas()
    inner = pdf.row_id.map(lambda r: int(hashlib.md5(f"42|inner|{r}".encode()).hexdigest()[:8], 16) % 5)
    train, valid = pdf.role == "train", pdf.role == "valid"

    def fit(own):
        x, y = own[xcols].to_numpy(), own.target.to_numpy()
        out = []
        for name in sorted(loeo.LEARNERS):
            z = np.column_stack([np.ones(len(x)), x, y])
            out.append(grams.solve(z.T @ z, **loeo.LEARNERS[name]))
        return np.column_stack(out)

    design = lambda own: np.column_stack([np.ones(len(own)), own[xcols].to_numpy()])
    p, y = [], []
    for j in range(5):
        held = pdf[train & (inner == j)]
        p.append(design(held) @ fit(pdf[train & (inner != j)]))
        y.append(held.target)
    p, y = np.vstack(p), np.concatenate(y)
    meta = np.linalg.lstsq(np.column_stack([np.ones(len(p)), p]), y, rcond=None)[0]
    want = np.column_stack([np.ones(valid.sum()), design(pdf[valid]) @ fit(pdf[train])]) @ meta
    env = idx.where("k = 2").first().test_env
    got = {r.row_id: r.y_pred for r in loeo.loeo_stack(spark, SF_SMALL).where(F.col("test_env") == env).collect()}
    assert got == pytest.approx(dict(zip(pdf[valid].row_id, want)), abs=1e-5)


def test_report_sets_stand_by_their_manifest(spark, tmp_path):
    path = str(tmp_path / "reports")
    one = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "environment string, x double")
    io.write_reports({"metrics": one, "chosen": one}, path)
    io.write_reports({"metrics": spark.createDataFrame([("b", 5.0), ("c", 6.0)], "environment string, x double")}, path)
    io.write_partitioned(spark.createDataFrame([("a", 9.0)], "environment string, x double"), f"{path}/metrics/run=half", by=("environment",))  # never listed
    assert {(r.environment, r.x) for r in io.read_report(spark, path, "metrics").collect()} == {("a", 1.0), ("b", 5.0), ("c", 6.0)}
    assert io.read_report(spark, path, "chosen").count() == 2
    with pytest.raises(ValueError):
        io.read_report(spark, path, "selection")
