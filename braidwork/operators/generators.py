"""Rows from collections: exploding arrays, maps, structs and Variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_array(df: DataFrame, column: str, value: str, *, outer: bool = False, ordinal: str | None = None) -> DataFrame:
    """A row for each item; outer keeps rows without one, ordinal adds the 0-based place as a long."""
    if ordinal is None:
        return df.select("*", (F.explode_outer if outer else F.explode)(column).alias(value))
    out = df.select("*", (F.posexplode_outer if outer else F.posexplode)(column).alias(ordinal, value))
    return out.withColumn(ordinal, F.col(ordinal).cast("long"))


def explode_map(df: DataFrame, column: str, key: str, value: str, *, outer: bool = False, ordinal: str | None = None) -> DataFrame:
    """A row for each entry."""
    if ordinal is None:
        return df.select("*", (F.explode_outer if outer else F.explode)(column).alias(key, value))
    out = df.select("*", (F.posexplode_outer if outer else F.posexplode)(column).alias(ordinal, key, value))
    return out.withColumn(ordinal, F.col(ordinal).cast("long"))


def explode_struct(df: DataFrame, column: str, scope: str, *, outer: bool = False, ordinal: str | None = None) -> DataFrame:
    """A row for each struct of an array, as the struct column scope."""
    return explode_array(df, column, scope, outer=outer, ordinal=ordinal)


def inline_struct(df: DataFrame, column: str, *, outer: bool = False) -> DataFrame:
    """A row for each struct of an array, its fields as columns."""
    return df.select("*", (F.inline_outer if outer else F.inline)(column))


def variant_explode(df: DataFrame, column: str, *, outer: bool = False) -> DataFrame:
    """A row (pos, key, value) for each child of a Variant."""
    tvf = df.sparkSession.tvf
    child = (tvf.variant_explode_outer if outer else tvf.variant_explode)(F.col(column).outer())
    return df.lateralJoin(child, how="left" if outer else "inner")
