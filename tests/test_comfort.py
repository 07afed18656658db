"""The survey view of the order tables: line sums in whole hundredths, its joins run once per run."""

from pyspark.sql import functions as F

from strata.plans import q_split
from strata.sources import tables
from tests.conftest import SF_SMALL


def test_hundredths_are_those_of_the_decimal_cast(spark):
    values = [0.0, -0.0, 0.07, 0.145, -0.145, 0.005, 1.005, 2.675, -17.35, 50.0, 0.1 + 0.2, 1 / 3, 99999999.99, 1234567890.12, -9999999999.99, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(tables.hundredths(F.col("x")).alias("a"), (F.col("x").cast("decimal(12,2)") * 100).cast("long").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


def test_folds_run_the_views_joins_once(spark, monkeypatch):
    read, seen = tables.read, []
    monkeypatch.setattr(tables, "read", lambda s, d, name: seen.append(name) or read(s, d, name))
    numbered = []
    kfold = q_split.split.kfold
    monkeypatch.setattr(q_split.split, "kfold", lambda df, **kw: numbered.append(df) or kfold(df, **kw))
    q_split.placed_folds(spark, SF_SMALL)
    assert seen.count("lineitem") == 1
    assert "Join" not in numbered[0]._jdf.queryExecution().optimizedPlan().toString()
