"""Ridge and level sums with a categorical of many levels: every customer is a level."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grams, metrics, wide
from ..session import staged
from ..sources.tables import COMFORT_SPEC, read, with_sql
from ..spec import DEFAULT
from .catalog import register
from .q_split import FOLDS_SQL, KS_SQL, placed_folds

ENV, SPEC = "environment", COMFORT_SPEC
WIDE = "customer"

# A customer in eleven is missing, so that the mode is used.
WIDE_SQL = FOLDS_SQL + f""",
{KS_SQL},
owned AS (SELECT f.*, CASE WHEN o.o_custkey % 11 <> 0 THEN CAST(o.o_custkey AS VARCHAR) END AS customer
          FROM folds f JOIN orders o ON f.row_id = o.o_orderkey),
trained AS (SELECT environment, k, customer, count(*) AS n, sum(target) AS sy FROM owned, ks WHERE fold <> k GROUP BY ALL),
modes AS (SELECT environment, k, customer AS mode FROM trained WHERE customer IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY environment, k ORDER BY n DESC, customer) = 1),
levels AS (SELECT environment, k, coalesce(customer, mode) AS level, sum(n) AS n, sum(sy) AS sy
           FROM trained JOIN modes USING (environment, k) GROUP BY ALL),
codes AS (SELECT level, row_number() OVER (ORDER BY md5(level), level) - 1 AS code FROM (SELECT DISTINCT level FROM levels))"""


def owned_folds(spark, sf):
    """The folds with each order's customer as a categorical of many levels."""
    key = F.col("o_custkey")
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.when(key % 11 != 0, key.cast("string")).alias(WIDE))
    return staged(placed_folds(spark, sf).join(orders, "row_id"), "owned")


@register("T05_wide_levels", with_sql(WIDE_SQL) + """SELECT environment, k, code, level, CAST(n AS BIGINT) AS n, round(sy * 1000000) / 1000000 AS sy
FROM levels JOIN codes USING (level)""")
def q_wide_levels(spark, sf):
    """T02, T05 as sparse sums: training rows and target sums of every level of every context, with the level's code."""
    rows = owned_folds(spark, sf)
    found = wide.level_sums(rows, grams.fit(rows, SPEC, DEFAULT.folds), WIDE, wide.modes(rows, ENV, WIDE, DEFAULT.folds))
    coded = found.join(wide.level_codes(found), "level")
    return coded.select(F.col("env").alias(ENV), "k", "code", "level", F.col("g")[0].cast("long").alias("n"), F.element_at("g", -1).alias("sy"))


@register("M02_ridge_wide")
def q_ridge_wide(spark, sf):
    """M02 on all features and the customers' levels: held-out metrics of every environment."""
    oof = staged(wide.oof(owned_folds(spark, sf), SPEC, DEFAULT.folds, WIDE), "oof")
    return metrics.regression_metrics(oof, [ENV, "model"])
