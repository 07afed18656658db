"""Cleaning rules on the dirty-value fixture of FIXTURES.md §1.1."""

import pytest
from pyspark.sql import functions as F

from strata.functions.columns import clean_numeric_string, to_class, to_numeric
from strata.operators import clean


def test_dirty_values(spark):
    vals = [" 1 2.5 ", "", "nan", "NA", "N/A", "abc", "3"]
    df = spark.createDataFrame([(v,) for v in vals], "raw string")
    out = df.select("raw", clean_numeric_string("raw").alias("c")).withColumn("n", to_numeric("c")).collect()
    got = {r.raw: (r.c, r.n) for r in out}
    assert got[" 1 2.5 "] == ("12.5", 12.5)
    for v in ("", "nan", "NA", "N/A"):
        assert got[v] == (None, None)
    assert got["abc"] == ("abc", None)
    # ignore mode: a column with 'abc' stays text, an all-numeric one becomes double
    two = spark.createDataFrame([("abc", "1"), ("2", " 3 ")], "a string, b string")
    conv, decision = clean.numeric_if_all_parse(clean.clean_strings(two, ["a", "b"]), ["a", "b"])
    types = dict(conv.dtypes)
    assert types["a"] == "string" and types["b"] == "double"


@pytest.mark.parametrize("name,excluded", [
    ("Sr.No.", True), (" Sr. No. ", True), ("SR  NO", True), ("S.No.", True), ("s no.", True),
    ("Given Final TSV", True), ("RH", False), ("Season", False), ("Snow", False)])
def test_serial_and_target_exclusion(name, excluded):
    assert clean.is_excluded_name(name, "Given Final TSV") is excluded


def test_id_rule_keeps_quirk(spark):
    df = spark.createDataFrame([(1, 0.5, None, 2.0)], "row_id long, Humidity double, empty double, RH double")
    out, dropped = clean.drop_id_and_empty(df)
    assert set(dropped) == {"row_id", "Humidity", "empty"} and out.columns == ["RH"]
    out2, dropped2 = clean.drop_id_and_empty(df, whole_word=True)
    assert "Humidity" not in dropped2


def test_class_rounding_half_even(spark):
    df = spark.createDataFrame([(v,) for v in (-3.7, -2.5, -0.5, 0.5, 1.5, 2.5, 9.0)], "y double")
    got = [r.c for r in df.select(to_class("y").alias("c")).collect()]
    assert got == [-3, -2, 0, 0, 2, 2, 3]
