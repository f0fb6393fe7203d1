"""Registry of named queries and their DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables. The
oracle SQL (if the query has one) sees the tables as views plus the
``reviews`` / ``metadata`` fixture views from :mod:`ranktide.sources.fixtures`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ranktide.sources.fixtures import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None, raw_sql: bool = False):
    """Register ``fn`` as query ``name``; ``oracle`` is DuckDB SQL.

    The SQL is prefixed with the fixture views (``raw_sql`` is kept for
    callers that build complete statements; the views are harmless there).
    """

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return deco


def load_all() -> None:
    """Import every query module so their ``register`` calls run."""
    from ranktide.plans import (  # noqa: F401
        q_clean,
        q_eda,
        q_features,
        q_filters,
        q_io,
        q_models,
        q_prep,
        q_retrieval,
        q_text,
    )
