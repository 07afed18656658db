"""Table access and the bindings of the library's data model to the driver tables.

The library works on one long survey table ``(row_id, environment, features..., target)``.
No climate survey ships with the test data, so ``comfort`` derives one from the
order tables (one row per order, five market segments as environments).  Every
query reads these tables, so its work grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from ..spec import FeatureSpec

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

COMFORT_SPEC = FeatureSpec(
    row_id="row_id",
    env="environment",
    target="target",
    num_cols=("f_total", "f_lines", "f_qty", "f_disc", "f_tax"),
    cat_cols=("season", "clothing", "activity"),
)

# Deterministic prediction "models" used by the metric / test / report operators.
PRED_MODELS = ("stacked_ensemble", "linear_qty", "linear_disc", "blend_noisy", "constant")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order line aggregates. Sums of whole hundredths keep the features engine-exact."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax")
    total = lambda c: (F.sum(hundredths(F.col(c))).cast("double") / F.lit(100.0))
    return li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"),
        total("l_quantity").alias("qty"),
        total("l_discount").alias("disc"),
        total("l_tax").alias("tax"),
    )


def hundredths(x: Column) -> Column:
    """``cast(x as decimal(12,2))`` in hundredths, as a long; only values that are not plainly of two decimals go through the slow cast."""
    scaled = x * F.lit(100.0)
    plain = (F.abs(scaled) < F.lit(1e9)) & (F.abs(scaled - F.rint(scaled)) < F.lit(1e-4))
    return F.when(plain, F.rint(scaled).cast("long")).otherwise((x.cast("decimal(12,2)") * F.lit(100).cast("decimal(3,0)")).cast("long"))


def comfort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical survey view (one row per order)."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                             "o_totalprice", "o_orderpriority")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    lines = order_line_stats(spark, sf_dir)
    j = (o.join(c, o.o_custkey == c.c_custkey)
         .join(n, c.c_nationkey == n.n_nationkey)
         .join(r, n.n_regionkey == r.r_regionkey)
         .join(lines, o.o_orderkey == lines.l_orderkey, "left"))
    f_qty = F.col("qty") / F.col("n_lines")
    f_disc = F.col("disc") / F.col("n_lines")
    raw = (F.coalesce((f_qty - F.lit(25.5)) / F.lit(8.0), F.lit(0.0))
           + F.coalesce((f_disc - F.lit(0.05)) * F.lit(20.0), F.lit(0.0))
           + ((F.col("o_orderkey") * 7919) % 1000).cast("double") / F.lit(1000.0) - F.lit(0.5))
    target = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.bround(raw, 0)))
    return j.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("c_mktsegment").alias("environment"),
        F.col("r_name").alias("season"),
        F.col("o_orderpriority").alias("clothing"),
        F.col("o_orderstatus").alias("activity"),
        F.col("o_totalprice").alias("f_total"),
        F.col("n_lines").alias("f_lines"),
        f_qty.alias("f_qty"),
        f_disc.alias("f_disc"),
        (F.col("tax") / F.col("n_lines")).alias("f_tax"),
        target.cast("double").alias("target"),
    )


def comfort_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``comfort`` written once, for runs that read it more than once: its joins and line sums are their largest scan."""
    return staged(comfort(spark, sf_dir), "comfort")


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second fixture: events as a survey with text-typed measurements."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id")
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    k = F.col("event_id") % 10
    raw = (F.when(k == 0, F.lit("NA"))
           .when(k == 1, F.lit(""))
           .when(k == 2, F.concat(F.lit(" "), F.substring(cents, 1, 1), F.lit(" "),
                                  F.substring(cents, 2, 100), F.lit(" ")))
           .when(k == 3, F.lit("N/A"))
           .when(k == 4, F.lit("nan"))
           .when(k == 5, F.lit("abc"))
           .otherwise(cents))
    return e.select(
        F.col("event_id").alias("row_id"),
        F.col("event_type").alias("environment"),
        raw.alias("reading"),
        F.col("user_id").cast("string").alias("user_code"),
        F.col("value").alias("target"),
    )


def _model_exprs():
    qty_t = F.coalesce((F.col("f_qty") - F.lit(25.5)) / F.lit(8.0), F.lit(0.0))
    disc_t = F.coalesce((F.col("f_disc") - F.lit(0.05)) * F.lit(20.0), F.lit(0.0))
    noise = ((F.col("row_id") * 31) % 100).cast("double") / F.lit(100.0) - F.lit(0.5)
    return {
        "stacked_ensemble": F.lit(0.9) * (qty_t + disc_t) + F.lit(0.05),
        "linear_qty": qty_t,
        "linear_disc": disc_t,
        "blend_noisy": F.lit(0.5) * (qty_t + disc_t) + noise,
        "constant": F.lit(0.0),
    }


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long prediction table ``(row_id, environment, model, y_true, y_pred)``."""
    return predictions_from(comfort(spark, sf_dir))


def predictions_from(cf: DataFrame, extra=()) -> DataFrame:
    """Models are fixed affine expressions of the features, expanded by ``explode`` of a
    five-element array (no join).  ``extra`` columns (e.g. ``fold``) are carried."""
    exprs = _model_exprs()
    arr = F.array(*[F.struct(F.lit(m).alias("model"), e.cast("double").alias("y_pred"))
                    for m, e in exprs.items()])
    return (cf.select("row_id", "environment", *extra, F.col("target").alias("y_true"),
                      F.explode(arr).alias("p"))
            .select("row_id", "environment", *extra, "p.model", "y_true", "p.y_pred"))


# ----------------------------------------------------------------------------------------
# DuckDB forms of the same bindings (used by oracle SQL).
# ----------------------------------------------------------------------------------------

COMFORT_SQL = """
comfort AS (
  SELECT o.o_orderkey AS row_id, c.c_mktsegment AS environment,
         r.r_name AS season, o.o_orderpriority AS clothing, o.o_orderstatus AS activity,
         o.o_totalprice AS f_total, l.n_lines AS f_lines,
         l.qty/l.n_lines AS f_qty, l.disc/l.n_lines AS f_disc, l.tax/l.n_lines AS f_tax,
         greatest(-3.0::double, least(3.0::double, round_even(
           coalesce((l.qty/l.n_lines-25.5::double)/8.0::double, 0.0::double)
           + coalesce((l.disc/l.n_lines-0.05::double)*20.0::double, 0.0::double)
           + cast((o.o_orderkey*7919)%1000 AS double)/1000.0::double - 0.5::double, 0))) AS target
  FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey
  JOIN nation n ON c.c_nationkey=n.n_nationkey JOIN region r ON n.n_regionkey=r.r_regionkey
  LEFT JOIN (SELECT l_orderkey, cast(count(*) AS double) n_lines,
               cast(sum(cast(l_quantity AS decimal(12,2))) AS double) qty,
               cast(sum(cast(l_discount AS decimal(12,2))) AS double) disc,
               cast(sum(cast(l_tax AS decimal(12,2))) AS double) tax
             FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey=o.o_orderkey
)"""

DIRTY_EVENTS_SQL = """
dirty AS (
  SELECT event_id AS row_id, event_type AS environment,
         CASE event_id % 10
           WHEN 0 THEN 'NA' WHEN 1 THEN ''
           WHEN 2 THEN ' ' || substr(cast(cast(round(value*100) AS bigint) AS varchar), 1, 1) || ' '
                       || substr(cast(cast(round(value*100) AS bigint) AS varchar), 2, 100) || ' '
           WHEN 3 THEN 'N/A' WHEN 4 THEN 'nan' WHEN 5 THEN 'abc'
           ELSE cast(cast(round(value*100) AS bigint) AS varchar) END AS reading,
         cast(user_id AS varchar) AS user_code, value AS target
  FROM events
)"""

_QTY = "coalesce((f_qty-25.5::double)/8.0::double, 0.0::double)"
_DISC = "coalesce((f_disc-0.05::double)*20.0::double, 0.0::double)"
_NOISE = "(cast((row_id*31)%100 AS double)/100.0::double - 0.5::double)"
_MODEL_SQL = {
    "stacked_ensemble": f"0.9::double*({_QTY}+{_DISC})+0.05::double",
    "linear_qty": _QTY,
    "linear_disc": _DISC,
    "blend_noisy": f"0.5::double*({_QTY}+{_DISC})+{_NOISE}",
    "constant": "0.0::double",
}

def preds_sql(src: str = "comfort", name: str = "preds", extra: str = "") -> str:
    """CTE body expanding ``src`` into the five prediction models."""
    return f"{name} AS (\n" + "\n  UNION ALL\n".join(
        f"  SELECT row_id, environment, {extra}'{m}' AS model, target AS y_true, cast({e} AS double) AS y_pred FROM {src}"
        for m, e in _MODEL_SQL.items()) + "\n)"


PREDICTIONS_SQL = COMFORT_SQL + ",\n" + preds_sql()


def with_sql(*ctes: str) -> str:
    """Join CTE bodies into a WITH prefix."""
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n"
