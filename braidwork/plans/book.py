"""Where queries and their SQL are noted down."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Book:
    """Queries by the name of their function; each function takes Tables."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def note(function: Callable[[Tables], DataFrame]):
            name = function.__name__
            if name in self.queries:
                raise ValueError(f"{name} is there already")
            self.queries[name] = lambda spark, folder: function(Tables(spark, folder))
            if sql is not None:
                self.sql[name] = sql
            return function

        return note
