"""A registry of queries: a job over the given tables and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import Views, with_views

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """Queries by name, with their oracle SQL (DuckDB) where SQL can express them."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, long: str = "") -> Callable[[Callable[..., DataFrame]], Query]:
        """Register f(v) as a query of f's name, where v(name) reads an input table or view; sql may name views.

        Whole numbers come out as longs; `long` names the columns that the SQL must cast to that.
        """

        def register(f: Callable[..., DataFrame]) -> Query:
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                df = f(Views(spark, sf_dir))
                return df.select([df[c].cast("long").alias(c) if kind in ("int", "smallint") else df[c] for c, kind in df.dtypes])

            query.__name__, query.__doc__ = f.__name__, f.__doc__
            self.queries[f.__name__] = query
            if sql:
                casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in long.split())
                self.sql[f.__name__] = f"SELECT * REPLACE ({casts}) FROM ({with_views(sql)})" if casts else with_views(sql)
            return query

        return register
