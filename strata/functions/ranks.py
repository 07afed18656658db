"""Row numbers and tie-averaged ranks inside large groups, without one task per group.

A window ``PARTITION BY env ORDER BY x`` puts a whole environment into one task.  Both
helpers split each group into order-preserving sub-buckets, rank inside the
sub-bucket (parallel), and add the size of all earlier sub-buckets from a small
per-group count table.  The result equals the global group-wise rank exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import monotone_bucket


def salted_row_number(df: DataFrame, keys, hex_key: str, tie: str, out: str = "rn",
                      salt_chars: int = 3, bucket=None) -> DataFrame:
    """1-based ``row_number() OVER (PARTITION BY keys ORDER BY hex_key, tie)``.

    ``hex_key`` is a hex digest; its first ``salt_chars`` characters are the sub-bucket
    (16**salt_chars per group), so ordering by (bucket, key) is ordering by key.  A
    different order-preserving ``bucket`` column can be given instead."""
    keys = list(keys)
    b = bucket if bucket is not None else F.substring(F.col(hex_key), 1, salt_chars)
    d = df.withColumn("_salt", b)
    # the bucket leads: rows are told apart by the sort's leading bytes, which a group's name leaves equal
    local = Window.partitionBy("_salt", *keys).orderBy(hex_key, tie)
    d = d.withColumn("_local", F.row_number().over(local))
    sizes = d.groupBy("_salt", *keys).agg(F.count(F.lit(1)).alias("_sz"))
    wo = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_sz").over(wo), F.lit(0))).drop("_sz")
    return (d.join(offsets, ["_salt", *keys])
            .withColumn(out, (F.col("_off") + F.col("_local")).cast("long"))
            .drop("_salt", "_local", "_off"))


def rank_counts(counts: DataFrame, keys, v: str = "v", n: str = "n", per_octave: int = 4096) -> DataFrame:
    """For a distinct-value count table ``(keys, v, n)`` add ``below`` (number of rows with a
    smaller value in the group) and ``avg_rank`` (1-based rank averaged over ties)."""
    keys = list(keys)
    unb = Window.unboundedPreceding
    c = counts.withColumn("_b", monotone_bucket(v, per_octave))
    wi = Window.partitionBy(*keys, "_b").orderBy(v).rowsBetween(unb, -1)
    c = c.withColumn("_in", F.coalesce(F.sum(n).over(wi), F.lit(0)))
    sizes = c.groupBy(*keys, "_b").agg(F.sum(n).alias("_bn"))
    wo = Window.partitionBy(*keys).orderBy("_b").rowsBetween(unb, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_bn").over(wo), F.lit(0))).drop("_bn")
    c = c.join(offsets, keys + ["_b"])
    below = F.col("_off") + F.col("_in")
    return (c.withColumn("below", below.cast("long"))
            .withColumn("avg_rank", below.cast("double") + (F.col(n).cast("double") + F.lit(1.0)) / F.lit(2.0))
            .drop("_b", "_in", "_off"))
