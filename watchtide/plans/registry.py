"""Registry of queries over the given tables, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from watchtide.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from watchtide.plans import (  # noqa: F401
        queries_cases, queries_detect, queries_evaluate, queries_graph, queries_ingest, queries_policy, queries_sources, queries_stream)
    return QUERIES, ORACLES
