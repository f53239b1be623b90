"""Queries of the reference's operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .inputs import Tables, with_ctes

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"two queries are called {name}")
    _QUERIES[name] = query
    if sql:
        _ORACLES[name] = with_ctes(sql)


def both(name: str, sql: str) -> None:
    """A query whose SQL Spark and DuckDB read alike."""
    full = with_ctes(sql)
    register(name, lambda spark, sf_dir: Tables(spark, sf_dir).sql(full), sql)


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function of the tables under a name, with the DuckDB SQL that checks it."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        register(name, lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql)
        return f

    return add


def _load() -> None:
    from . import aggregates, changes, decisions, fusion, joins, more, projections, rules, scalars, sets, sources, streams  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of points of interest, scored and decided."""
    return queries()["i01_pair_decisions"](spark, sf_dir)
