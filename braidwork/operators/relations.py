"""Rows of one relation: filters, projections, order, limits, samples, selection of one row a key, and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .guards import NotAdmitted, _with_guard, batch_only, best_ties
from .names import unused


def where(df: DataFrame, *predicates: Column) -> DataFrame:
    """Rows that satisfy all predicates."""
    for p in predicates:
        df = df.where(p)
    return df


def project(df: DataFrame, names: Sequence[str], **new: Column) -> DataFrame:
    """The named columns, then the new ones; a new one of the same name takes the place of the old."""
    return df.select(*[new[n].alias(n) if n in new else F.col(n) for n in names], *[c.alias(n) for n, c in new.items() if n not in names])


def order_by(df: DataFrame, *orderings: Column | str) -> DataFrame:
    batch_only(df, "order_by")
    return df.orderBy(*orderings)


def limit(df: DataFrame, count: int, *orderings: Column | str) -> DataFrame:
    """The first rows of an order, without a full sort."""
    if count < 0 or not orderings:
        raise ValueError("limit needs a count of 0 or more and an order")
    batch_only(df, "limit")
    return df.orderBy(*orderings).limit(count)


def offset(df: DataFrame, count: int, *orderings: Column | str) -> DataFrame:
    """All rows of an order but the first ones."""
    if count < 0 or not orderings:
        raise ValueError("offset needs a count of 0 or more and an order")
    batch_only(df, "offset")
    return df.orderBy(*orderings).offset(count)


def sample(df: DataFrame, fraction: float, *, with_replacement: bool = False, seed: int | None = None, reproducible: bool = True) -> DataFrame:
    """A Bernoulli sample, or a Poisson sample with replacement."""
    if fraction < 0 or (fraction > 1 and not with_replacement):
        raise ValueError("fraction is 0 to 1, or 0 and more with replacement")
    if seed is None and reproducible:
        raise ValueError("a reproducible sample needs a seed")
    batch_only(df, "sample")
    return df.sample(with_replacement, fraction, seed) if seed is not None else df.sample(with_replacement, fraction)


def _one(df: DataFrame, by: str, partition_by: Sequence[str], latest: bool, ties: str) -> DataFrame:
    if ties not in ("error", "any"):
        raise ValueError("ties is error or any")
    batch_only(df, "latest_by" if latest else "earliest_by")
    keys = list(partition_by)
    order = F.desc_nulls_last(by) if latest else F.asc_nulls_last(by)
    place = unused("place", df.columns)
    one = df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col(place) == 1).drop(place)
    if ties == "any":
        return one
    tied = best_ties(df, keys, by, latest)
    return _with_guard(one, tied, "TIE", f"equal {by} within {', '.join(keys)}")


def latest_by(df: DataFrame, by: str, *, partition_by: Sequence[str], ties: str = "error") -> DataFrame:
    """One row of each partition, that with the greatest value; null is the least. ties: error or any."""
    return _one(df, by, partition_by, True, ties)


def earliest_by(df: DataFrame, by: str, *, partition_by: Sequence[str], ties: str = "error") -> DataFrame:
    """One row of each partition, that with the least value; null is the greatest."""
    return _one(df, by, partition_by, False, ties)


dedupe_latest_by = latest_by
dedupe_earliest_by = earliest_by


def select_first_qualified(df: DataFrame, keys: Sequence[str], *, where: Column, order_by: str, missing: str = "allow", ties: str = "error") -> DataFrame:
    """Of each key's rows that qualify the first in order. missing="error" raises where a key has none that qualifies; ties raise."""
    if missing not in ("allow", "error"):
        raise ValueError("missing is allow or error")
    keys = list(keys)
    ranked = df.where(where)
    chosen = earliest_by(ranked, order_by, partition_by=keys, ties=ties)
    if missing == "error":
        none = df.groupBy(*keys).agg(F.count_if(where).alias("n")).where("n = 0")
        chosen = _with_guard(chosen, none, "NONE_QUALIFIES", f"no row qualifies for a key of {', '.join(keys)}")
    return chosen


def top_k(df: DataFrame, k: int, *, partition_by: Sequence[str], order_by: Sequence[Column], rank: str = "rank") -> DataFrame:
    """The first k rows of each partition, with their place in a new column; one of that name that df has already is an error."""
    batch_only(df, "top_k")
    if unused(rank, df.columns) != rank:
        raise ValueError(f"there is a column {rank} already; name another")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*partition_by).orderBy(*order_by))).where(F.col(rank) <= k)


def distinct(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_duplicates(df: DataFrame, *subset: str) -> DataFrame:
    """One row for each value of the subset; a stream forgets beyond its watermark."""
    if df.isStreaming:
        return drop_duplicates_within_watermark(df, *subset)
    return df.dropDuplicates(list(subset) or None)


def drop_duplicates_within_watermark(df: DataFrame, *subset: str) -> DataFrame:
    if not df.isStreaming:
        raise ValueError("only a stream has a watermark")
    return df.dropDuplicatesWithinWatermark(list(subset) or None)


def _same_shape(a: DataFrame, b: DataFrame) -> None:
    kinds = lambda df: [(f.name, f.dataType) for f in df.schema]
    if kinds(a) != kinds(b):
        raise ValueError("the relations have different columns")


def _both_or_neither(a: DataFrame, b: DataFrame) -> None:
    if a.isStreaming != b.isStreaming:
        raise NotAdmitted("a stream is united with streams only")


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    _same_shape(a, b)
    _both_or_neither(a, b)
    return a.unionAll(b)


def union_by_name(a: DataFrame, b: DataFrame, *, allow_missing_columns: bool = False, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Columns by name. Missing ones are null, or the default of their name (a dotted path for a field of a struct)."""
    _both_or_neither(a, b)
    if defaults and not allow_missing_columns:
        raise ValueError("defaults need allow_missing_columns")
    out = [a, b]
    for path, value in (defaults or {}).items():
        top, *rest = path.split(".")
        for i, df in enumerate(out):
            if not rest and top not in df.columns:
                out[i] = df.withColumn(top, F.lit(value).cast(out[1 - i].schema[top].dataType))
            elif rest and top in df.columns and rest[0] not in df.schema[top].dataType.fieldNames():
                out[i] = df.withColumn(top, F.col(top).withField(".".join(rest), F.lit(value)))
    return out[0].unionByName(out[1], allowMissingColumns=allow_missing_columns)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    batch_only(a, "intersect")
    batch_only(b, "intersect")
    return a.intersect(b)


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    batch_only(a, "intersect_all")
    batch_only(b, "intersect_all")
    return a.intersectAll(b)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    batch_only(a, "subtract")
    batch_only(b, "subtract")
    return a.subtract(b)


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    batch_only(a, "except_all")
    batch_only(b, "except_all")
    return a.exceptAll(b)


def cache(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    return df.persist(level)


def boundary(df: DataFrame, name: str) -> DataFrame:
    """A named view of df, read again: shorter plan text, the same plan. The view itself goes; what was read from it stays."""
    df.createOrReplaceTempView(name)
    table = df.sparkSession.table(name)
    df.sparkSession.catalog.dropTempView(name)
    return table
