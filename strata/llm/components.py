"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged


def _with_least(arcs: DataFrame) -> DataFrame:
    """Arcs (u, v) with m, the least of u and its neighbours; the minimum is combined map-side."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return arcs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    return _with_least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    hung = _with_least(down)
    return (hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(hung.select("u", F.col("m").alias("v"))).distinct())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of a link; component is its smallest reachable node.

    Loops, repeated and reversed links change nothing; links with a null end are left out.
    Nodes without links are not listed.  An empty table gives an empty result.  Each round
    is written to the shared folder; the number of rounds grows with the logarithm of the
    longest path, and only two sums per round reach the driver.
    """
    edges = staged(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        edges = staged(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
