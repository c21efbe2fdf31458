"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame`` and,
where the result is expressible in plain SQL, an independent DuckDB oracle text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    oracle: str | None


_REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Query(name, fn, oracle)
        return fn

    return deco


def all_queries() -> dict[str, Query]:
    # importing the modules fills the registry
    from pricelens.plans import (  # noqa: F401
        q_clean,
        q_conform,
        q_estimates,
        q_ledger,
        q_load,
        q_mart,
        q_pages,
        q_retrieval,
        q_io,
        q_streaming,
    )

    return dict(_REGISTRY)
