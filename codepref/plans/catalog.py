"""Registry of named queries: each is a Spark builder ``(spark, sf_dir) ->
DataFrame`` plus, where SQL can express it, the DuckDB oracle text over the
driver tables (fixture views inlined as CTEs)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so its queries register."""
    from codepref.plans import (  # noqa: F401
        q_evaluate, q_filters, q_io, q_normalize, q_preference, q_profile, q_sampling, q_tokens, q_vectors)
