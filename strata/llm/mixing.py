"""Mixing sources to target weights: hash-random order, prefix sums of sizes, an exact cut per source.

Every document gets a random key from a hash of its id.  The documents of a source are
range-sorted by key, prefix sums of their sizes are computed over the range parts, and the
source's budget cuts the order at its exact word; a budget beyond the source's size repeats
the whole source first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import join_stats
from ..session import staged
from .order import group_key, running

# Words: runs of anything but the six blanks.
WORD = r"[^\x20\x09-\x0D]++"


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """(source_key, source_size, weight) from (source_key, source, source_size): weights repeat over the sources in code-point order, null last."""
    placed = running(sources.withColumns({"n": F.lit(1).cast("long"), "__last": F.col("source").isNull()}), ["__last", "source"], ["n"], sources.count())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    return placed.select("source_key", "source_size", F.element_at(cycle, (F.pmod("before_n", F.lit(len(weights))) + 1).cast("int")).alias("weight"))


def targets(sources: DataFrame, share: float, epochs: int) -> DataFrame:
    """``sources`` (source_key, source_size, weight) with target: its part of share * all sizes.

    Budgets go by weight; a source's stops at epochs * its size, and what is over goes to the
    others by weight until none is above.  In the order of cap over weight the sources that
    are full come first, so the level that the others reach is the largest of
    (budget - caps of the earlier) / (weights of the rest): two prefix sums and a maximum.
    A weight that is null or not above zero gets a target of 0.
    """
    live = sources.where("weight > 0").withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    weights, n = live.agg(F.sum("weight"), F.count(F.lit(1))).first()
    ordered = running(live.withColumn("ratio", F.col("cap") / F.col("weight")), ["ratio", "source_key"], ["cap", "weight"], n)
    level = ordered.agg(F.max((F.lit(budget * share) - F.col("before_cap")) / (F.lit(weights) - F.col("before_weight")))).first()[0]
    part = F.least(F.col("source_size") * float(epochs), F.lit(level) * F.col("weight"))
    return sources.withColumn("target", F.when(F.col("weight") > 0, part).otherwise(0.0))


def mix(docs: DataFrame, weights: Sequence[float] | DataFrame, share: float = 1.5, epochs: int = 2, seed: str = "mix", text_col: str = "text", source_col: str = "source",
        id_col: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """What the mix takes of every document: (id_col, size, source_size, target, taken, order_key) and the columns of keep.

    weights: a list that repeats over the sources in code-point order, null last; or a
    table (source, weight).  taken counts words, epochs included: the document at a source's
    cut is taken in part, so a source's taken words are its target's whole words.  order_key
    is the random place of a document in its source.  Documents with one key (a repeated or
    null id) go by size; rows that are alike in both are interchangeable, so reruns give the
    same rows.  Null and empty texts have size 0 and nothing is taken; a null source is a
    source.  A long text counts whole.  Empty tables give an empty result.  keep carries
    columns along, the text for ``drawn``; without it only a few numbers of a row are moved.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-"))))
    kept = F.struct(F.lit(0).alias("__none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)))
    slim = staged(docs.select(group_key(source_col).alias("source_key"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{id_col}`").alias("id"), n_words(f"`{text_col}`").alias("size"),
                              key.alias("order_key"), kept.alias("kept")), "mix")
    sizes = staged(slim.groupBy("source_key").agg(F.max("source").alias("source"), F.sum("size").alias("source_size")), "mix")
    if isinstance(weights, DataFrame):
        own = weights.select(group_key("source").alias("source_key"), F.col("weight").cast("double").alias("weight"))
        weighed = sizes.join(own, "source_key", "left").select("source_key", "source_size", "weight")
    else:
        weighed = cycled_weights(sizes, weights)
    goal = targets(weighed, share, epochs).withColumn("__words", F.floor("target"))
    goal = goal.withColumn("__times", F.when(F.col("source_size") > 0, F.expr("__words div source_size")).otherwise(0))
    goal = goal.select("source_key", "source_size", "target", "__times", (F.col("__words") - F.col("__times") * F.col("source_size")).alias("__rest"))
    rows = join_stats(running(slim, ["order_key", "id", "size"], ["size"], slim.count(), ["source_key"]), goal, ["source_key"])
    taken = F.col("__times") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - F.col("before_size")))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), "order_key", *(F.col(f"kept.c{i}").alias(c) for i, c in enumerate(keep) if c != id_col))


def drawn(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mixture itself: a row per document and epoch that ``mix(..., keep=[text, ...])`` takes, with epoch (from 1) and the text.

    The last epoch of a document may hold only its first words; blanks between them stay.
    """
    rows = mixed.where("taken > 0").withColumn("epoch", F.explode(F.expr("sequence(1, cast(ceil(taken / size) as int))")))
    words = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    first = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+" + WORD + "){"), words.cast("string"), F.lit("}"))
    cut = F.call_function("regexp_extract", F.col(f"`{text_col}`"), first, F.lit(0))
    return rows.withColumn(text_col, F.when(words < F.col("size"), cut).otherwise(F.col(f"`{text_col}`")))
