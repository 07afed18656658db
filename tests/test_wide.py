"""A categorical of many levels: the same fits as with its columns built, and 100,000 levels without a column or a collect of them."""

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import grams, wide
from strata.plans.q_wide import WIDE, owned_folds
from strata.sources.tables import COMFORT_SPEC as SPEC
from strata.spec import FeatureSpec
from tests.conftest import SF_SMALL

LEVELS = 100_000


def by_row(rows):
    return {r.row_id: (r.fold, r.y_true, r.y_pred) for r in rows.collect()}


def test_equals_ridge_on_built_columns(spark):
    rows = owned_folds(spark, SF_SMALL)
    assert rows.where(F.col(WIDE).isNull()).count()  # the mode is used
    built = SPEC.with_features(cat_cols=[*SPEC.cat_cols, WIDE])
    want = by_row(grams.oof(rows, built, 5, {"ridge": dict(kind="ridge", alpha=2.0)}))
    got = by_row(wide.oof(rows, SPEC, 5, WIDE, alpha=2.0))
    assert got.keys() == want.keys() and len(got) == rows.count()
    assert all(got[i] == pytest.approx(want[i], abs=1e-8) for i in want)


def test_a_column_without_values_adds_nothing(spark):
    rows = owned_folds(spark, SF_SMALL).withColumn(WIDE, F.lit(None).cast("string"))
    want = by_row(grams.oof(rows, SPEC, 5, {"ridge": dict(kind="ridge", alpha=1.0)}))
    got = by_row(wide.oof(rows, SPEC, 5, WIDE))
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-8) for i in want)


def test_alpha_must_be_positive(spark):
    with pytest.raises(ValueError):
        wide.ridge(None, None, 0.0)


def test_many_levels(spark, monkeypatch):
    spec = FeatureSpec(num_cols=("a", "b"))
    n = 150_000
    i = F.col("id")
    level = F.when(i < n // 3, F.lit("hot")).otherwise(F.concat(F.lit("v"), (i - n // 3).cast("string")))
    df = spark.range(n).select(i.alias("row_id"), F.lit("e").alias("environment"), (i % 2).cast("int").alias("fold"), level.alias("level"),
                               ((i * 7919) % 1000 / 1000.0).alias("a"), ((i * 104729) % 977 / 977.0).alias("b"))
    hot = F.when(F.col("level") == "hot", 1.0).otherwise(0.0)
    df = df.withColumn("target", F.col("a") * 2 - F.col("b") + (F.col("row_id") % 13).cast("double") / 13 + hot)
    collected, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: (lambda rows: (collected.append(len(rows)), rows)[1])(collect(self)))
    contexts = grams.fit(df, spec, 2)
    mode = wide.modes(df, "environment", "level", 2)
    sums = wide.level_sums(df, contexts, "level", mode)
    fits = wide.ridge(grams.cells(df, contexts), sums, 1.0)
    found = wide.effects(sums, fits, 1.0)
    assert max(collected, default=0) <= 2  # the contexts, never levels
    assert len(contexts.columns) == 2
    codes = wide.level_codes(sums).agg(F.count("*"), F.countDistinct("code"), F.min("code"), F.max("code")).first()
    assert tuple(codes) == (LEVELS + 1, LEVELS + 1, 0, LEVELS)
    monkeypatch.undo()

    # the equations that ridge solves, at its solution: per level and for intercept and features
    w = {r.k: np.array(r.w) for r in fits.collect()}
    gram = {r.k: grams.square(r.g) for r in grams.cells(df, contexts).where("side = 0").collect()}
    both = found.join(sums, ["env", "k", "level"]).where("k = 0").toPandas()
    v, u = np.array(both.g.tolist()), both.effect.to_numpy()
    assert len(both) == len(set(both.level)) == LEVELS // 2 + 1
    assert v[:, -1] - v[:, :-1] @ w[0] - (v[:, 0] + 1.0) * u == pytest.approx(np.zeros(len(u)), abs=1e-8)
    g = gram[0]
    left = g[:-1, -1] - g[:-1, :-1] @ w[0] - v[:, :-1].T @ u - np.append(0.0, w[0][1:])
    assert left == pytest.approx(np.zeros(3), abs=1e-5)
