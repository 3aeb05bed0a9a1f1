"""Registered queries: one per operator of the inventory.

Each entry is ``name -> (spark_fn(spark, sf_dir) -> DataFrame, oracle_sql | None)``.
Every query reads the driver's tables through the ``media_raw`` fixture (or
``documents`` directly) and runs over whole tables.
"""

from __future__ import annotations

from typing import Callable, Optional

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, Optional[str]]] = {}


def query(name: str, oracle: Optional[str] = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = (fn, oracle)
        return fn
    return deco


def load_all() -> dict[str, tuple[QueryFn, Optional[str]]]:
    # importing the modules registers their queries
    from medialake.plans import (q_sources, q_exprs, q_filters, q_joins,  # noqa: F401
                                 q_organize, q_merge, q_stats)
    return REGISTRY
