"""The queries by name, each with the SQL that states the same result where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritrail.plans.fixtures import Fixtures, fixtures, with_views

_builders: dict[str, Callable[[Fixtures], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``builder(fixtures) -> DataFrame`` under ``name``."""

    def add(builder):
        _builders[name] = builder
        if sql is not None:
            _sql[name] = sql
        return builder

    return add


def _load() -> None:
    from veritrail.plans import (  # noqa: F401
        crawl_queries,
        evaluation_queries,
        flow_queries,
        report_queries,
        retrieval_queries,
        scoring_queries,
        source_queries,
        stream_queries,
    )


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {
        name: (lambda spark, folder, build=build: build(fixtures(spark, folder)))
        for name, build in _builders.items()
    }


def check_sql() -> dict[str, str]:
    _load()
    return {name: with_views(text) for name, text in _sql.items()}
