"""Queries F01-F13 (F09 intentionally unused)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import clean_numeric_string, to_numeric
from ..operators import clean
from ..sources.tables import COMFORT_SQL, DIRTY_EVENTS_SQL, PREDICTIONS_SQL, comfort, dirty_events, \
    predictions, with_sql
from .catalog import register

CLEAN_SQL = ("CASE WHEN replace(trim(reading), ' ', '') IN ('', 'nan', 'NA', 'N/A') THEN NULL "
             "ELSE replace(trim(reading), ' ', '') END")
NUM_SQL = f"CASE WHEN isnan(TRY_CAST({CLEAN_SQL} AS DOUBLE)) THEN NULL ELSE TRY_CAST({CLEAN_SQL} AS DOUBLE) END"


@register("F01_clean_numeric_string", with_sql(DIRTY_EVENTS_SQL) +
          f"SELECT row_id, environment, {CLEAN_SQL} AS reading FROM dirty")
def q_f01(spark, sf):
    d = dirty_events(spark, sf)
    return d.select("row_id", "environment", clean_numeric_string("reading").alias("reading"))


@register("F02_to_numeric_coerce", with_sql(DIRTY_EVENTS_SQL) +
          f"SELECT row_id, environment, round({NUM_SQL}, 6) AS reading FROM dirty")
def q_f02(spark, sf):
    d = clean.clean_strings(dirty_events(spark, sf), ["reading"])
    return clean.coerce_numeric(d, ["reading"]).select("row_id", "environment", "reading")


@register("F03_to_numeric_ignore", with_sql(DIRTY_EVENTS_SQL) + f"""
SELECT column_name, n_values, n_numeric, n_values = n_numeric AS to_numeric FROM (
  SELECT 'reading' AS column_name, count({CLEAN_SQL}) AS n_values, count({NUM_SQL}) AS n_numeric FROM dirty
  UNION ALL
  SELECT 'user_code', count(user_code),
         count(CASE WHEN isnan(TRY_CAST(user_code AS DOUBLE)) THEN NULL ELSE TRY_CAST(user_code AS DOUBLE) END)
  FROM dirty)""")
def q_f03(spark, sf):
    d = clean.clean_strings(dirty_events(spark, sf), ["reading", "user_code"])
    _, decision = clean.numeric_if_all_parse(d, ["reading", "user_code"])
    return decision


@register("F04_exclude_columns", with_sql(COMFORT_SQL) +
          "SELECT row_id, environment, round(f_qty,6) AS f_qty, season FROM comfort")
def q_f04(spark, sf):
    cf = comfort(spark, sf)
    wide = cf.select("row_id", "environment", "f_qty", "season",
                     F.col("row_id").alias("Sr.No."), F.col("row_id").alias(" S No. "),
                     F.col("row_id").alias("SR  NO"), F.col("target").alias("Given Final TSV"))
    return clean.exclude_columns(wide, target="Given Final TSV")


@register("F05_drop_id_and_empty", with_sql(COMFORT_SQL) +
          "SELECT environment, round(f_qty,6) AS f_qty, round(target,6) AS target FROM comfort")
def q_f05(spark, sf):
    cf = comfort(spark, sf)
    wide = cf.select("row_id", "environment", "f_qty", F.col("f_disc").alias("Humidity"),
                     F.lit(None).cast("double").alias("empty_col"), "target")
    out, _ = clean.drop_id_and_empty(wide)
    return out


REQUIRED = ("f_total", "f_lines", "f_qty", "RH")


@register("F06_required_columns_audit", with_sql(COMFORT_SQL) + """
SELECT environment, column_name, present, n_nonnull, n_nonnull = 0 AS all_null FROM (
  SELECT environment, 'f_total' AS column_name, true AS present, count(f_total) AS n_nonnull FROM comfort GROUP BY 1
  UNION ALL SELECT environment, 'f_lines', true, count(f_lines) FROM comfort GROUP BY 1
  UNION ALL SELECT environment, 'f_qty', true, count(f_qty) FROM comfort GROUP BY 1
  UNION ALL SELECT environment, 'RH', false, 0::bigint FROM comfort GROUP BY 1)""")
def q_f06(spark, sf):
    return clean.required_columns_audit(comfort(spark, sf), "environment", REQUIRED)


@register("F07_skip_incomplete_env", with_sql(COMFORT_SQL) + """
, sw AS (SELECT row_id, environment,
        CASE WHEN environment = 'AUTOMOBILE' THEN NULL ELSE f_lines END AS door,
        f_qty AS window_open, f_total AS fan FROM comfort)
SELECT row_id, environment FROM sw WHERE environment IN (
  SELECT environment FROM sw GROUP BY environment
  HAVING count(door) > 0 AND count(window_open) > 0 AND count(fan) > 0)""")
def q_f07(spark, sf):
    cf = comfort(spark, sf)
    sw = cf.select("row_id", "environment",
                   F.when(F.col("environment") == "AUTOMOBILE", F.lit(None)).otherwise(F.col("f_lines"))
                   .alias("door"), F.col("f_qty").alias("window_open"), F.col("f_total").alias("fan"))
    return clean.skip_incomplete_env(sw, "environment", ["door", "window_open", "fan"]) \
        .select("row_id", "environment")


@register("F08_filter_valid_target", with_sql(DIRTY_EVENTS_SQL) + f"""
SELECT row_id, environment, round(t, 6) AS target FROM (SELECT row_id, environment, {NUM_SQL} AS t FROM dirty)
WHERE t IS NOT NULL""")
def q_f08(spark, sf):
    d = dirty_events(spark, sf)
    d = d.select("row_id", "environment", to_numeric(clean_numeric_string("reading")).alias("target"))
    return clean.filter_valid_target(d, "target")


_ENVS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _f10_sql():
    cols = []
    for e in _ENVS:
        for p in ("RH", "Top"):
            cols.append(f"round(cast({'f_disc' if p == 'RH' else 'f_qty'} AS double) * "
                        f"CASE WHEN environment = '{e}' THEN 1.0 ELSE 0.0 END, 6) AS \"{p}_{e}\"")
    return with_sql(COMFORT_SQL) + "SELECT row_id, environment, round(f_disc,6) AS RH, round(f_qty,6) AS Top, " + \
        ", ".join(cols) + " FROM comfort"


@register("F10_add_environment_interactions", _f10_sql())
def q_f10(spark, sf):
    cf = comfort(spark, sf).select("row_id", "environment", F.col("f_disc").alias("RH"),
                                   F.col("f_qty").alias("Top"))
    envs = [r[0] for r in cf.select("environment").distinct().collect()]  # a handful of names
    return clean.add_environment_interactions(cf, "environment", sorted(envs), physical=["RH", "Top"])


@register("F11_sample_weight", with_sql(COMFORT_SQL) + """
, pooled AS (SELECT row_id, CASE WHEN environment IN ('AUTOMOBILE','BUILDING') THEN 'pool_a' ELSE 'pool_b' END AS grp,
        CASE WHEN environment = 'MACHINERY' THEN 'MACHINERY' WHEN environment IN ('AUTOMOBILE','BUILDING')
             THEN environment ELSE 'OTHER' END AS sub_env FROM comfort)
SELECT row_id, grp, sub_env, round(CASE WHEN count(DISTINCT sub_env) OVER (PARTITION BY grp) > 1
       THEN 1.0 / count(*) OVER (PARTITION BY grp, sub_env) ELSE 1.0 END, 6) AS sample_weight FROM pooled""")
def q_f11(spark, sf):
    cf = comfort(spark, sf)
    pooled = cf.select(
        "row_id",
        F.when(F.col("environment").isin("AUTOMOBILE", "BUILDING"), "pool_a").otherwise("pool_b").alias("grp"),
        F.when(F.col("environment") == "MACHINERY", "MACHINERY")
        .when(F.col("environment").isin("AUTOMOBILE", "BUILDING"), F.col("environment"))
        .otherwise("OTHER").alias("sub_env"))
    return clean.sample_weight(pooled, "grp", "sub_env")


_CLASS_SQL = "cast(round_even(greatest(-3.0::double, least(3.0::double, {c})), 0) AS INTEGER)"
_LABEL_SQL = ("CASE WHEN cast({k} AS double) < -0.5 THEN 'Cool' WHEN cast({k} AS double) < 0.5 "
              "THEN 'Neutral' ELSE 'Warm' END")


@register("F12_to_class", with_sql(PREDICTIONS_SQL) +
          f"SELECT row_id, model, {_CLASS_SQL.format(c='y_true')} AS true_class, "
          f"{_CLASS_SQL.format(c='y_pred')} AS pred_class FROM preds")
def q_f12(spark, sf):
    p = clean.with_class_columns(predictions(spark, sf), "y_true", "y_pred")
    return p.select("row_id", "model", "true_class", "pred_class")


@register("F13_classify3", with_sql(PREDICTIONS_SQL) +
          f"SELECT row_id, model, {_LABEL_SQL.format(k=_CLASS_SQL.format(c='y_true'))} AS true_label, "
          f"{_LABEL_SQL.format(k=_CLASS_SQL.format(c='y_pred'))} AS pred_label FROM preds")
def q_f13(spark, sf):
    p = clean.with_class_columns(predictions(spark, sf), "y_true", "y_pred")
    return p.select("row_id", "model", "true_label", "pred_label")
