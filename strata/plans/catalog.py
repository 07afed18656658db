"""Registry of named queries: one per operator ID of the survey inventory.

Each entry is a Spark callable ``(spark, sf_dir) -> DataFrame`` and, where the result
is expressible in SQL, the DuckDB statement over the same parquet tables that must
give the same rows.  Double columns of every Spark result are rounded to 6 places,
and every oracle statement rounds its doubles the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import round_doubles


@dataclass(frozen=True)
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    bench: bool = False


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, bench: bool = False):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, run, sql, bench)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules fills the registry.
    import importlib
    for mod in QUERY_MODULES:
        importlib.import_module(f"{__package__}.{mod}")
    return REGISTRY


QUERY_MODULES = ("q_sources", "q_clean", "q_split", "q_prep", "q_metrics", "q_report", "q_stats", "q_models", "q_score", "q_stack", "q_ml", "q_runs", "stacked", "q_wide", "q_rbf", "q_compare")
