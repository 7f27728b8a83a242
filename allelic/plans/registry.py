"""Registered queries: a Spark callable and, beside it, SQL for DuckDB over the same inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import ctes, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FULL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}  # too large for DuckDB, so without SQL


def query(*inputs: str, sql: str | None = None, more: str = "", **given):
    """Registers a function of the named inputs and of the arguments ``given``. ``sql`` selects from them; ``more`` adds CTEs before it."""

    def register(f: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(load(spark, sf_dir, name) for name in inputs), **given)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = ctes(*inputs, duckdb=True) + (f", {more}" if more else "") + f" {sql}"
        return f

    return register


def full(f: Callable[..., DataFrame], *inputs: str, **given) -> None:
    """Registers ``f`` of the named inputs a second time, as NAME_full with the arguments ``given``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(*(load(spark, sf_dir, name) for name in inputs), **given)

    FULL[f"{f.__name__}_full"] = run
