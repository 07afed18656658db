"""Global order without a global task: range-sorted tables with row numbers, and prefix sums over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import join_stats
from ..session import staged

# Rows that a range partition should hold.
PART_ROWS = 500_000


def in_order(rows: DataFrame, by: Sequence[str], n_rows: int, tag: str = "order", part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` range-sorted by ``by`` (nulls first) and written, with ``part`` (its partition) and ``row``.

    ``row`` grows along the whole order and counts by one inside a part.  Rows that tie are
    cut apart at their place in the input, so that no key has to lie in one part; n_rows
    sets the number of parts.  Columns called part, row or __at are replaced.
    """
    default = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(default, -(-n_rows // part_rows))
    keys = [*by, "__at"]
    return staged(rows.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("__at")
                  .withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), tag)


def running(rows: DataFrame, by: Sequence[str], values: Sequence[str], n_rows: int, group: Sequence[str] = ()) -> DataFrame:
    """``rows`` with before_<value>: the sum of the value over the rows that come earlier in ``by`` in their group.

    Each part adds up its own rows; the sums of the earlier parts come from a table of one
    row per part and group.  Group columns hold no nulls, value columns neither.
    """
    ordered = in_order(rows, [*group, *by], n_rows)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    local = earlier(Window.partitionBy("part", *group).orderBy("row"))
    inside = ordered.withColumns({f"before_{v}": F.coalesce(F.sum(v).over(local), F.lit(0)) for v in values})
    sums = ordered.groupBy("part", *group).agg(*(F.sum(v).alias(f"__{v}") for v in values))
    parts = earlier(Window.partitionBy(*group, *[F.lit(0)] * (not group)).orderBy("part"))
    offsets = sums.select("part", *group, *(F.coalesce(F.sum(f"__{v}").over(parts), F.lit(0)).alias(f"__off_{v}") for v in values))
    placed = join_stats(inside, offsets, ["part", *group])
    return placed.withColumns({f"before_{v}": F.col(f"before_{v}") + F.col(f"__off_{v}") for v in values}).drop("part", "row", *(f"__off_{v}" for v in values))


def group_key(column: str):
    """The column as text that is never null: ``=`` and the value, or nothing for null; it sorts as the column does, null first."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit(""))
