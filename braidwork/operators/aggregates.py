"""Grouped metrics. Every metric takes where=, a filter on the rows it sees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _only(value, where: Column | None) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value if where is None else F.when(where, value)


def _metric(function):
    def metric(value, *, where: Column | None = None) -> Column:
        return function(_only(value, where))

    metric.__name__ = function.__name__
    return metric


count_distinct = _metric(F.count_distinct)
min = _metric(F.min)  # noqa: A001
max = _metric(F.max)  # noqa: A001
avg = _metric(F.avg)
sum = _metric(F.sum)  # noqa: A001
bool_and = _metric(F.bool_and)
bool_or = _metric(F.bool_or)
stddev = _metric(F.stddev_samp)
variance = _metric(F.var_samp)
skewness = _metric(F.skewness)
kurtosis = _metric(F.kurtosis)
schema_of_variant_agg = _metric(F.schema_of_variant_agg)
collect_set = _metric(F.collect_set)


def count(*, where: Column | None = None) -> Column:
    """Rows, or rows that satisfy where."""
    return F.count(F.lit(1)) if where is None else F.count_if(where)


def mode(value, *, deterministic: bool = False, where: Column | None = None) -> Column:
    """The most frequent value; deterministic takes the least of equally frequent ones."""
    return F.mode(_only(value, where), deterministic)


def corr(left, right, *, where: Column | None = None) -> Column:
    return F.corr(_only(left, where), _only(right, where))


def covar(left, right, *, where: Column | None = None) -> Column:
    return F.covar_samp(_only(left, where), _only(right, where))


def approx_count_distinct(value, *, relative_sd: float | None = None, where: Column | None = None) -> Column:
    return F.approx_count_distinct(_only(value, where), relative_sd)


def approx_percentile(value, percentage: float, *, accuracy: int = 10_000, where: Column | None = None) -> Column:
    return F.percentile_approx(_only(value, where), percentage, accuracy)


def percentile(value, percentage: float, *, frequency: int = 1, where: Column | None = None) -> Column:
    """Exact, interpolated."""
    return F.percentile(_only(value, where), percentage, frequency)


def collect_list(value, *, order_by=None, where: Column | None = None) -> Column:
    """Values without nulls; in the order of order_by, then of the values."""
    chosen = _only(value, where)
    if order_by is None:
        return F.collect_list(chosen)
    key = F.col(order_by) if isinstance(order_by, str) else order_by
    pairs = F.sort_array(F.collect_list(F.when(chosen.isNotNull(), F.struct(key.alias("k"), chosen.alias("v")))))
    return F.transform(pairs, lambda p: p["v"])


def first_value(value, *, order_by, where: Column | None = None) -> Column:
    """The value at the least key (a bare column)."""
    return F.min_by(value, _only(order_by, where))


def last_value(value, *, order_by, where: Column | None = None) -> Column:
    """The value at the greatest key (a bare column)."""
    return F.max_by(value, _only(order_by, where))


def _keys(keys, named: dict[str, Column]) -> list:
    return [*keys, *[c.alias(n) for n, c in named.items()]]


def group_by(df: DataFrame, *keys, metrics: dict[str, Column], having: Column | None = None, **named: Column) -> DataFrame:
    """Grouped metrics by their names; no keys: one row. having sees the metrics."""
    out = df.groupBy(*_keys(keys, named)).agg(*[c.alias(n) for n, c in metrics.items()])
    return out if having is None else out.where(having)


def rollup(df: DataFrame, *keys, metrics: dict[str, Column], **named: Column) -> DataFrame:
    return df.rollup(*_keys(keys, named)).agg(*[c.alias(n) for n, c in metrics.items()])


def cube(df: DataFrame, *keys, metrics: dict[str, Column], **named: Column) -> DataFrame:
    return df.cube(*_keys(keys, named)).agg(*[c.alias(n) for n, c in metrics.items()])


def grouping_sets(df: DataFrame, levels: Sequence[Sequence[str]], *, metrics: dict[str, Column]) -> DataFrame:
    """All levels from one scan and one shuffle."""
    keys = list(dict.fromkeys(k for level in levels for k in level))
    return df.groupingSets([[F.col(k) for k in level] for level in levels], *keys).agg(*[c.alias(n) for n, c in metrics.items()])


def grouping_id() -> Column:
    """A bit for each key, the leftmost the highest: 1 where it is aggregated away."""
    return F.grouping_id()


def is_grouped(key) -> Column:
    return F.grouping(key) == 1
