"""Exact grouped quantiles that never gather a whole group into one task.

Spark's exact ``percentile`` merges every distinct value of a group in one buffer; with
one environment holding a third of all rows that is one task holding a third of the
data.  Here a quantile is located in three small steps:

1. ``value_counts``: distinct ``(keys, v) -> n`` (map-side combined),
2. per-key counts of a monotone value sub-bucket and their running offsets (small table),
3. only the sub-bucket that contains the wanted rank is sorted, in parallel per key.

Interpolation is linear between the order statistics at floor/ceil of ``(N-1)·p``
(NumPy's default, DuckDB's ``quantile_cont``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def monotone_bucket(v, per_octave: int = 4096) -> Column:
    """Integer bucket id that is non-decreasing in ``v`` (sign, binary exponent, leading
    mantissa bits).  Equal values share a bucket; order(bucket, v) == order(v)."""
    v = F.col(v) if isinstance(v, str) else v
    a = F.abs(v)
    e = F.floor(F.log2(a))
    frac = a / F.pow(F.lit(2.0), e) - F.lit(1.0)  # exact: division by a power of two
    mag = (e + F.lit(1100)) * F.lit(per_octave) + F.floor(frac * F.lit(per_octave)) + F.lit(1)
    return (F.when(v == 0, F.lit(0))
            .when(v > 0, mag)
            .otherwise(-mag)).cast("long")


def value_counts(df: DataFrame, keys, value: str, out: str = "v", weight: str | None = None) -> DataFrame:
    """``(keys..., v, n)`` for the non-null values of ``value``."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return (df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
            .groupBy(*keys, F.col(value).alias(out)).agg(n.alias("n")))


def quantiles_from_counts(counts: DataFrame, keys, probs, v: str = "v", n: str = "n",
                          per_octave: int = 4096) -> DataFrame:
    """Linear-interpolated quantiles ``(keys..., p, q)`` from a distinct-value count table.

    Shuffles: sub-bucket counts, one window over the (small) bucket table, one join of
    the located buckets back to their values, one window inside those buckets, one
    final aggregation."""
    keys = list(keys)
    unb = Window.unboundedPreceding
    base = counts.select(*keys, F.col(v).alias("_v"), F.col(n).alias("_n")) \
        .withColumn("_b", monotone_bucket("_v", per_octave))
    buckets = base.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    wk = Window.partitionBy(*keys)
    buckets = (buckets.withColumn("_before", F.coalesce(F.sum("_bn").over(wk.orderBy("_b").rowsBetween(unb, -1)),
                                                        F.lit(0)))
               .withColumn("_N", F.sum("_bn").over(wk)))
    # order statistics each probability needs: floor and ceil of (N - 1) p
    wanted = []
    for p in probs:
        h = (F.col("_N") - 1).cast("double") * F.lit(float(p))
        lo, hi = F.floor(h).cast("long"), F.ceil(h).cast("long")
        for r in (lo, hi):
            wanted.append(F.struct(F.lit(float(p)).alias("p"), h.alias("h"), lo.alias("lo"), hi.alias("hi"),
                                   r.alias("r")))
    inside_bucket = F.filter(F.array_distinct(F.array(*wanted)),
                             lambda t: (t["r"] >= F.col("_before")) & (t["r"] < F.col("_before") + F.col("_bn")))
    located = buckets.select(*keys, "_b", "_before", F.explode(inside_bucket).alias("t")) \
        .select(*keys, "_b", "_before", "t.*")
    vals = base.join(located, keys + ["_b"])
    wv = Window.partitionBy(*keys, "p", "r").orderBy("_v").rowsBetween(unb, 0)
    vals = vals.withColumn("_cum", F.col("_before") + F.sum("_n").over(wv))
    picked = vals.where((F.col("_cum") - F.col("_n") <= F.col("r")) & (F.col("r") < F.col("_cum")))
    res = picked.groupBy(*keys, "p").agg(
        F.first("h").alias("_h"), F.first("lo").alias("_lo"), F.first("hi").alias("_hi"),
        F.max(F.when(F.col("r") == F.col("lo"), F.col("_v"))).alias("_xlo"),
        F.max(F.when(F.col("r") == F.col("hi"), F.col("_v"))).alias("_xhi"))
    d = F.col("_h") - F.col("_lo").cast("double")
    q = F.when(F.col("_lo") == F.col("_hi"), F.col("_xlo")).otherwise(
        F.col("_xlo") + (F.col("_xhi") - F.col("_xlo")) * d)
    return res.select(*keys, "p", q.alias("q"))


def grouped_quantiles(df: DataFrame, keys, value: str, probs, per_octave: int = 4096,
                      wide: dict | None = None) -> DataFrame:
    """Quantiles of ``value`` per ``keys``.  With ``wide={p: name}`` the result has one
    column per probability instead of ``(p, q)`` rows."""
    q = quantiles_from_counts(value_counts(df, keys, value), keys, probs, per_octave=per_octave)
    return pivot_quantiles(q, keys, wide) if wide else q


def pivot_quantiles(q: DataFrame, keys, names: dict) -> DataFrame:
    """``(keys, p, q)`` -> ``(keys, name_1, name_2, ...)`` without a shuffle-heavy pivot."""
    aggs = [F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(nm) for p, nm in names.items()]
    return q.groupBy(*keys).agg(*aggs)
