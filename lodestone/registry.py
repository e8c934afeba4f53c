"""Pairs of a query and the SQL that gives the same rows in another engine."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = (
    "plans.star",
    "sources.formats",
    "operators.project",
    "operators.joins",
    "operators.aggregates",
    "operators.windows",
    "operators.ranked",
    "operators.sets",
    "operators.udfs",
    "functions.scalars",
    "functions.vectors",
    "streaming.events",
    "corpus.exact_copies",
    "corpus.repeated_lines",
    "corpus.html_text",
    "corpus.conversations",
    "corpus.licences",
)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL of its oracle if SQL can express it."""

    def add(run: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = run
        if oracle:
            _ORACLES[name] = oracle
        return run

    return add


def sql_query(name: str, spark_sql: str, oracle: str | None = None, tables: str = "") -> None:
    """Register a query that is Spark SQL over the named tables; the oracle is the same SQL unless given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(spark_sql, **{t: table(spark, sf_dir, t) for t in tables.split()})

    query(name, _plain(spark_sql if oracle is None else oracle))(run)


def _plain(sql: str) -> str:
    """{table} markers as plain names."""
    return sql.replace("{", "").replace("}", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for module in _MODULES:
        import_module(f"lodestone.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
