"""Registered queries of the engine and their SQL, by operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import code_queries, family_queries, metric_queries, more_queries, report_queries, stat_queries, text_queries

_ALL = {**metric_queries.QUERIES, **report_queries.QUERIES, **stat_queries.QUERIES, **text_queries.QUERIES, **code_queries.QUERIES, **more_queries.QUERIES, **family_queries.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
