"""Joining rows with small statistics tables without moving the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, staged

# Replicas of a statistics table that is too large to broadcast; its rows' keys are dealt over as many salts.
SALTS = 32


def stats_table(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so later plans see its true size."""
    if getattr(df, "_stats_table", False):
        return df
    out = staged(df, "stats")
    out._stats_table = True
    return out


def join_stats(rows: DataFrame, stats: DataFrame, keys, how: str = "inner") -> DataFrame:
    """``rows`` joined with per-group statistics on ``keys`` (few values, perhaps one of them hot).

    The table is materialised and counted: up to ``BROADCAST_ROWS`` rows it is broadcast and
    the rows stay where they are; a larger one is replicated over salts that the rows draw
    by hash, so no key lands in one task.
    """
    keys = list(keys)
    stats = stats_table(stats)
    if stats.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(stats), keys, how)
    salted = stats.withColumn("_join_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALTS)).cast("int")
    return rows.withColumn("_join_salt", own).join(salted, [*keys, "_join_salt"], how).drop("_join_salt")
