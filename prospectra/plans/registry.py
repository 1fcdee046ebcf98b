"""Named queries: a function of (spark, sf_dir) and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """The queries of one module."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Register a query under its function's name, with its SQL if SQL can express it."""

        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = with_views(sql)
            return f

        return add
