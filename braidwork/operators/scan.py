"""Bounded ordered folds: each row sees the state that the rows before it have made."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .guards import _with_guard, batch_only


def scan(df: DataFrame, *, initial: Column, step: Callable[[Column, Column], Column], partition_by: Sequence[str], order_by: Sequence[str], max_rows: int, state: str = "state") -> DataFrame:
    """df with the struct column state, as it is before the row is applied by step(state, row).

    Raises on a null order key, on equal keys in a partition and on partitions of more than max_rows. The size is checked by an
    aggregate before a partition is collected, so an overlong one never becomes one value.
    """
    keys, order = list(partition_by), list(order_by)
    null = df.where(" or ".join(f"`{k}` is null" for k in order)).select(F.lit("null key").alias("what"))
    tied = df.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("tie").alias("what"))
    long = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_rows).select(F.lit("too many rows").alias("what"))
    batch_only(df, "scan")
    checked = _with_guard(df, null.unionAll(tied).unionAll(long), "SCAN", f"null or equal order keys, or more than {max_rows} rows in a partition")
    # sorted by the keys and a place: rows with maps can't be compared
    place = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(order)])
    grouped = checked.groupBy(*keys).agg(F.collect_list(F.struct(place.alias("key"), F.struct(*df.columns).alias("row"))).alias("rows"))
    by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    grouped = grouped.select(F.transform(F.array_sort("rows", by_key), lambda r: r["row"]).alias("rows"))
    rows = F.col("rows")
    kind = _type(df, initial)
    none = F.array().cast(f"array<{kind}>")
    # arrays are copied as they grow: chunks of the square root of the length keep that down to length times its root
    chunk = F.ceil(F.sqrt(F.size("rows"))).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("rows") / chunk).cast("int") - 1), lambda i: F.slice(rows, i * chunk + 1, chunk))
    inner = lambda now, some: F.aggregate(some, F.struct(now.alias("now"), none.alias("before")), lambda s, r: F.struct(step(s["now"], r).cast(kind).alias("now"), F.array_append(s["before"], s["now"]).alias("before")))
    one = lambda s, part: F.struct(part["now"].alias("now"), F.array_append(s["done"], part["before"]).alias("done"))
    start = F.struct(initial.cast(kind).alias("now"), F.array().cast(f"array<array<{kind}>>").alias("done"))
    folded = F.aggregate(chunks, start, lambda s, some: F.transform(F.array(inner(s["now"], some)), lambda part: one(s, part))[0], lambda s: F.flatten(s["done"]))
    pairs = grouped.select(F.explode(F.arrays_zip(rows.alias("r"), folded.alias("s"))).alias("p"))
    return pairs.select("p.r.*", F.col("p.s").alias(state))


def _type(df: DataFrame, initial: Column) -> str:
    return df.limit(0).select(initial.alias("s")).schema["s"].dataType.simpleString()
