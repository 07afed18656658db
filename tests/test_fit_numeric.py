"""Numeric statistics of all contexts from one location of order statistics (the step under F20-F38)."""

import random

import pytest

from strata.operators import prep

ENV = "environment"


def _long(spark, folds):
    rng, data = random.Random(1), []
    for env, n in (("a", 1), ("b", 2), ("c", 7), ("d", 60), ("e", 400), (None, 5)):
        for i in range(n):
            some = {"cont": rng.gauss(0, 1), "int": float(rng.randint(-2, 2)), "missing": None if rng.random() < 0.6 else rng.random() * 5, "none": None,
                    "wide": rng.gauss(0, 1) * 10 ** rng.randint(-5, 9), "ties": 3.0 if rng.random() < 0.7 else None if rng.random() < 0.4 else rng.gauss(3, 1)}
            data += [(i, env, i % 5, f, v) for f, v in some.items()]
    long = spark.createDataFrame(data, "row_id int, environment string, fold int, feature string, value double")
    return long if folds else long.drop("fold")


@pytest.mark.parametrize("folds", [5, None])
@pytest.mark.parametrize("per_octave", [4096, 2])
def test_equal_to_the_passes_one_after_the_other(spark, folds, per_octave):
    long, keys = _long(spark, folds), prep.ctx_keys(ENV, folds)
    counts = prep.staged(prep.context_counts(long, ENV, "value", folds), "counts")
    med = prep.small_table(prep.fit_median(counts, keys))
    cap = prep.small_table(prep.fit_cap(counts, med, keys))
    want = med.join(cap, keys).join(prep.fit_scale(counts, med, cap, keys), keys)
    assert sorted(map(tuple, prep.fit_numeric(long, ENV, folds, per_octave).collect())) == sorted(map(tuple, want.collect()))


def test_rows_are_not_shuffled_by_value(spark, monkeypatch):
    """What is written are tables of buckets and statistics, not one row for each value of each context."""
    written = []
    monkeypatch.setattr(prep, "staged", lambda df, tag, real=prep.staged: written.append(real(df, tag)) or written[-1])
    long = spark.range(40_000).selectExpr("id as row_id", "'e' as environment", "cast(id % 5 as int) as fold", "'x' as feature", "1.0 + id / 40000 as value")
    prep.fit_numeric(long.withColumn("value", long.value.cast("double")), ENV, 5)
    assert written and all(t.count() <= 5 * 4096 for t in written)
