"""Registered queries: one per operator of the inventory, each with the
equivalent DuckDB SQL where one exists. ``__spark_entry__`` exposes these.

Every query reads the driver tables of ``sf_dir`` in full. Doubles are
rounded to 6 places on both sides so float summation order cannot flip a hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries (idempotent)."""
    from cyclewise.plans import (q_drift, q_features, q_io, q_metrics, q_models, q_profile,  # noqa: F401
                                 q_regimes, q_stream, q_windows)
