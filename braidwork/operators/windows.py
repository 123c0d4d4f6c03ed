"""Analytic functions over partitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


@dataclass(frozen=True)
class Frame:
    rows: bool
    start: int
    end: int


def unbounded_preceding() -> int:
    return Window.unboundedPreceding


def unbounded_following() -> int:
    return Window.unboundedFollowing


def current_row() -> int:
    return Window.currentRow


def preceding(n: int) -> int:
    return -n


def following(n: int) -> int:
    return n


def rows_between(start: int, end: int) -> Frame:
    return Frame(True, start, end)


def range_between(start: int, end: int) -> Frame:
    return Frame(False, start, end)


def _list(x) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x]


def window(*, partition_by, order_by=None, frame: Frame | None = None, descending: bool = False) -> WindowSpec:
    """A window; order keys by name follow descending, others say themselves."""
    spec = Window.partitionBy(*_list(partition_by))
    if order_by is not None:
        spec = spec.orderBy(*[(F.desc(k) if descending else F.asc(k)) if isinstance(k, str) else k for k in _list(order_by)])
    if frame is not None:
        spec = spec.rowsBetween(frame.start, frame.end) if frame.rows else spec.rangeBetween(frame.start, frame.end)
    return spec


def _ranking(function):
    def ranked(*, partition_by, order_by, descending: bool = False) -> Column:
        return function().over(window(partition_by=partition_by, order_by=order_by, descending=descending)).cast("long")

    return ranked


row_number = _ranking(F.row_number)
rank = _ranking(F.rank)
dense_rank = _ranking(F.dense_rank)


def percent_rank(*, over: WindowSpec) -> Column:
    return F.percent_rank().over(over)


def cume_dist(*, over: WindowSpec) -> Column:
    return F.cume_dist().over(over)


def ntile(buckets: int, *, over: WindowSpec) -> Column:
    return F.ntile(buckets).over(over)


def lag(value, *, partition_by, order_by, offset: int = 1, default=None, descending: bool = False) -> Column:
    return F.lag(value, offset, default).over(window(partition_by=partition_by, order_by=order_by, descending=descending))


def lead(value, *, partition_by, order_by, offset: int = 1, default=None, descending: bool = False) -> Column:
    return F.lead(value, offset, default).over(window(partition_by=partition_by, order_by=order_by, descending=descending))


def nth_value(value, n: int, *, over: WindowSpec, ignore_nulls: bool = False) -> Column:
    return F.nth_value(value, n, ignore_nulls).over(over)


def first_value(value, *, over: WindowSpec, ignore_nulls: bool = False) -> Column:
    return F.first_value(value, F.lit(ignore_nulls)).over(over)


def last_value(value, *, over: WindowSpec, ignore_nulls: bool = False) -> Column:
    return F.last_value(value, F.lit(ignore_nulls)).over(over)


def _rolling(function):
    def rolled(value, *, partition_by, order_by, preceding: int, descending: bool = False) -> Column:
        return function(value).over(window(partition_by=partition_by, order_by=order_by, descending=descending, frame=rows_between(-preceding, 0)))

    return rolled


rolling_sum, rolling_avg, rolling_min, rolling_max = (_rolling(f) for f in (F.sum, F.avg, F.min, F.max))


def _framed(function):
    def framed(value, *, over: WindowSpec) -> Column:
        return function(value).over(over)

    return framed


window_sum, window_avg, window_min, window_max = (_framed(f) for f in (F.sum, F.avg, F.min, F.max))
window_bool_and, window_bool_or = _framed(F.bool_and), _framed(F.bool_or)
window_stddev, window_variance = _framed(F.stddev_samp), _framed(F.var_samp)
window_collect_list, window_collect_set = _framed(F.collect_list), _framed(F.collect_set)


def window_count(value=None, *, over: WindowSpec) -> Column:
    """Rows, or values that aren't null."""
    return F.count(F.lit(1) if value is None else value).over(over)


def window_count_distinct(value, *, over: WindowSpec) -> Column:
    """Different values in the frame, by a set, as Spark has no such aggregate over windows."""
    return F.size(F.collect_set(value).over(over))


