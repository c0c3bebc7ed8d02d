"""Named queries: a callable (spark, sf_dir) -> DataFrame, and where SQL can say the same, that SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkwell.session import ship

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"two queries are named {name}")

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                return fn(spark, sf_dir)

            run.__doc__ = fn.__doc__
            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return fn

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
