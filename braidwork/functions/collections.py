"""Array and map columns. Positions are 1-based as in Spark's element_at and slice; value[i] is 0-based."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import (  # noqa: F401
    array, array_contains, array_except, array_intersect, array_repeat, array_union, element_at, map_contains_key, map_entries,
    map_filter, map_from_entries, map_keys, map_values, map_zip_with, sequence, size, slice, try_element_at,
)

arr_position = F.array_position
arr_append = F.array_append
arr_prepend = F.array_prepend
arr_insert = F.array_insert
arr_remove = F.array_remove
arr_compact = F.array_compact
arr_distinct = F.array_distinct
arr_flatten = F.flatten
arr_reverse = F.reverse
arr_sort = F.array_sort
arr_transform = F.transform
arr_filter = F.filter
arr_exists = F.exists
arr_forall = F.forall
arr_zip_with = F.zip_with
arr_aggregate = F.aggregate
map_transform_values = F.transform_values


def arr_sort_by(value, key: Callable[[Column], Column], *, descending: bool = False) -> Column:
    """Sorted by a key of the items. Null keys are first ascending and last descending; equal keys keep their order."""

    def compare(a: Column, b: Column) -> Column:
        x, y = key(a), key(b)
        nulls = F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), -1).when(y.isNull(), 1)
        up = nulls.when(x < y, -1).when(x > y, 1).otherwise(0)
        return -up if descending else up

    return F.array_sort(value, compare)


def _filled(keep: Column, fill: Column) -> Column:
    return F.map_concat(keep, F.map_filter(fill, lambda k, v: ~F.map_contains_key(keep, k)))


def map_concat(*values, duplicates: str = "error") -> Column:
    """One map. A key that repeats is an error (Spark's default policy), or has its first or its last value."""
    if duplicates == "error":
        return F.map_concat(*values)
    if duplicates not in ("first", "last"):
        raise ValueError("duplicates is error, first or last")
    maps = [F.col(v) if isinstance(v, str) else v for v in values]
    one = maps[0]
    for other in maps[1:]:
        keep, fill = (one, other) if duplicates == "first" else (other, one)
        one = _filled(keep, fill)
    return one


def map_transform_keys(value, function: Callable[[Column, Column], Column]) -> Column:
    """New keys; keys that become equal are an error (Spark's default policy)."""
    return F.transform_keys(value, function)
