"""The queries of the library, and the same queries as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from varloom.plans import calls_queries, lookup_queries, reads_queries, stats_queries, summary_queries
from varloom.plans.projections import Tables, with_projections

ALL: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {**calls_queries.QUERIES, **stats_queries.QUERIES, **reads_queries.QUERIES, **lookup_queries.QUERIES, **summary_queries.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, f=f: f(Tables(spark, folder))) for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_projections(sql) for name, (_, sql) in ALL.items() if sql}
