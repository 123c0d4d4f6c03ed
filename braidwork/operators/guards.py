"""Assertions on relations that can't be optimised away.

A guard is a one-row relation whose single column is null or raises. The filter on it keeps it in the plan: the violation raises
in whatever action is run on the result, count() included. All checks are one aggregate or one anti join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import unused


class NotAdmitted(ValueError):
    """The shape isn't safe or possible on a stream."""


def batch_only(df: DataFrame, operation: str) -> None:
    if df.isStreaming:
        raise NotAdmitted(f"{operation} is for batches")


def _with_guard(df: DataFrame, violations: DataFrame, code: str, message: str) -> DataFrame:
    """df, if violations is empty; at most one row of it is read."""
    batch_only(df, f"a check ({code})")
    name = unused("guard", df.columns)
    guard = violations.limit(1).agg(F.assert_true(F.count(F.lit(1)) == 0, F.lit(f"{code}: {message}")).alias(name))
    return guard.where(F.col(name).isNull()).crossJoin(df).drop(name)


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, whose keys don't repeat; nulls are equal."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _with_guard(df, repeated, "KEY_REPEATS", f"repeated key ({', '.join(keys)})")


def require_all(df: DataFrame, predicate: Column) -> DataFrame:
    """df, whose rows all satisfy the predicate; null doesn't."""
    return _with_guard(df, df.where(~F.coalesce(predicate, F.lit(False))), "ROW_FAILS", "a row fails the predicate")


def require_reference(df: DataFrame, value: str, reference: DataFrame, reference_key: str, *, nulls: str = "allow") -> DataFrame:
    """df, whose values are all among the reference's keys. nulls: allow or reject."""
    if nulls not in ("allow", "reject"):
        raise ValueError("nulls is allow or reject")
    keys = reference.select(F.col(reference_key).alias("key_")).where("key_ is not null").distinct()
    lone = df.select(F.col(value).alias("value_")).join(keys, F.col("value_") == F.col("key_"), "left_anti")
    lone = lone.where("value_ is not null") if nulls == "allow" else lone
    return _with_guard(df, lone, "NO_REFERENCE", f"{value} without a row in the reference")


def exactly_one(df: DataFrame) -> DataFrame:
    """df, which has one row."""
    few = df.limit(2).agg(F.count(F.lit(1)).alias("n")).where("n <> 1")
    return _with_guard(df, few, "NOT_ONE_ROW", "the relation doesn't have exactly one row")


def best_ties(df: DataFrame, keys: list[str], by: str, latest: bool) -> DataFrame:
    """The keys whose greatest (or least) value several rows have. Two aggregates, the second over what the first has left; df isn't joined."""
    counted = df.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("n_"))
    best = (F.max_by if latest else F.min_by)("n_", by)
    return counted.groupBy(*keys).agg(F.coalesce(best, F.max("n_")).alias("n_")).where("n_ > 1")
