"""Where queries and their oracle SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Queries:
    """Named queries, and for each that SQL can express the SQL that gives the same rows."""

    def __init__(self):
        self.found: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(query: Query) -> Query:
            self.found[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return add
