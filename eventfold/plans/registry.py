"""Registry of named queries over the given tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventfold.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    """Import every module that registers queries."""
    from eventfold.plans import (  # noqa: F401
        q_edges,
        q_hub,
        q_index,
        q_items,
        q_replay,
        q_schema,
        q_sources,
        q_streams,
        q_talks,
    )
