"""All query modules of the library, joined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics, columns, custom, forms, pipelines, relational, streams

BOOKS = (relational.BOOK, analytics.BOOK, columns.BOOK, custom.BOOK, streams.BOOK, pipelines.BOOK, forms.BOOK)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for b in BOOKS for name, f in b.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for b in BOOKS for name, sql in b.sql.items()}
