"""Joins: enrichment, row sets, existence, validity ranges, as-of and intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .guards import _with_guard, batch_only, best_ties, exactly_one
from .names import unused

STRATEGIES = {"broadcast_hash": "broadcast", "shuffle_hash": "shuffle_hash", "sort_merge": "merge", "shuffle_replicate_nl": "shuffle_replicate_nl"}
HOW = ("left", "inner", "right", "full", "cross")
#: Rows of the side with values that band_join broadcasts; beyond, both sides are shuffled, the other one in so many parts of each bin.
BAND_ROWS, BAND_PARTS = 1_000_000, 16


def _hinted(df: DataFrame, strategy: str | None) -> DataFrame:
    if strategy is None:
        return df
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")
    return df.hint(STRATEGIES[strategy])


def rowset_join(left: DataFrame, right: DataFrame, on: str | Sequence[str] | Column, how: str = "inner", *, strategy: str | None = None) -> DataFrame:
    """Any join by any predicate; keys by name are merged."""
    if how not in HOW[:-1]:
        raise ValueError(f"how is one of {', '.join(HOW[:-1])}; cross_join is apart")
    return left.join(_hinted(right, strategy), list(on) if isinstance(on, (list, tuple)) else on, how)


def inner_join(left: DataFrame, right: DataFrame, on, *, strategy: str | None = None) -> DataFrame:
    return rowset_join(left, right, on, "inner", strategy=strategy)


def left_join(left: DataFrame, right: DataFrame, on, *, strategy: str | None = None) -> DataFrame:
    return rowset_join(left, right, on, "left", strategy=strategy)


def right_join(left: DataFrame, right: DataFrame, on, *, strategy: str | None = None) -> DataFrame:
    return rowset_join(left, right, on, "right", strategy=strategy)


def full_join(left: DataFrame, right: DataFrame, on, *, strategy: str | None = None) -> DataFrame:
    return rowset_join(left, right, on, "full", strategy=strategy)


def cross_join(left: DataFrame, right: DataFrame, *, allow_cartesian: bool = False) -> DataFrame:
    if not allow_cartesian:
        raise ValueError("a cross join needs allow_cartesian=True")
    return left.crossJoin(right)


def band_join(left: DataFrame, right: DataFrame, low: Column, high: Column, value: Column, *, width: float) -> DataFrame:
    """The pairs with low < value < high; low and high are of left, value is of right. Nulls and NaN don't match.

    An equi-join by bins of the given width, which a left row has all of that its band touches, so width is best the usual high - low. Left rows are dealt out to
    tasks, as few bins may have all of them; a right side of up to BAND_ROWS rows, counted here, is broadcast.
    """
    batch_only(left, "band_join")
    batch_only(right, "band_join")
    columns = [*left.columns, *right.columns]
    lo, hi, at, bin, part = (unused(n, columns) for n in ("low", "high", "value", "bin", "part"))
    number = lambda c: F.floor(c.cast("double") / width)
    spark = left.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bands = left.select("*", low.alias(lo), high.alias(hi)).where((F.col(lo) < F.col(hi)) & ~F.isnan(F.col(hi).cast("double"))).repartition(tasks)
    bands = bands.select("*", F.explode(F.sequence(number(F.col(lo)), number(F.col(hi)))).alias(bin))
    values = right.select("*", value.alias(at)).where(F.col(at).isNotNull() & ~F.isnan(F.col(at).cast("double"))).withColumn(bin, number(F.col(at)))
    if values.count() <= BAND_ROWS:
        joined = bands.join(F.broadcast(values), bin)
    else:
        bands = bands.withColumn(part, F.floor(F.rand(0) * BAND_PARTS)).repartition(tasks, bin, part)
        values = values.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BAND_PARTS - 1).cast("long")))).repartition(tasks, bin, part)
        joined = bands.join(values.hint("merge"), [bin, part])
    return joined.where((F.col(lo) < F.col(at)) & (F.col(at) < F.col(hi))).drop(lo, hi, at, bin, part)


def param_join(df: DataFrame, parameters: DataFrame) -> DataFrame:
    """df with the columns of the one row of parameters. The check is left out for streams."""
    one = parameters if df.isStreaming else exactly_one(parameters)
    return df.crossJoin(F.broadcast(one))  # one row


def exists(df: DataFrame, relation: DataFrame, on) -> DataFrame:
    return df.join(relation, on, "left_semi")


def not_exists(df: DataFrame, relation: DataFrame, on) -> DataFrame:
    return df.join(relation, on, "left_anti")


def lookup_join(df: DataFrame, relation: DataFrame, keys: Sequence[str], *, how: str = "left", latest_by: str | None = None, earliest_by: str | None = None, strategy: str | None = None) -> DataFrame:
    """Enrichment by keys of the same name. latest_by or earliest_by: of several rows of a key the one with the greatest or least such column; ties raise."""
    keys = list(keys)
    if how not in ("left", "inner"):
        raise ValueError("a lookup is left or inner")
    if latest_by and earliest_by:
        raise ValueError("latest_by or earliest_by, not both")
    if by := latest_by or earliest_by:
        tied = best_ties(relation, keys, by, bool(latest_by))
        place = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(by) if latest_by else F.asc_nulls_last(by))
        first = unused("place", relation.columns)
        relation = relation.withColumn(first, F.row_number().over(place)).where(F.col(first) == 1).drop(first)
        # on the result: an outer join whose right side nobody reads is optimised away
        return _with_guard(df.join(_hinted(relation, strategy), keys, how), tied, "TIE", f"equal {by} for a key")
    return df.join(_hinted(relation, strategy), keys, how)


def temporal_one(df: DataFrame, versions: DataFrame, keys: Sequence[str], at: str, valid_from: str, valid_to: str, *, how: str = "left", check_overlaps: bool = True) -> DataFrame:
    """The version of each row's keys that is valid at its time: valid_from <= at < valid_to, a null valid_to is open. Overlapping versions raise."""
    keys = list(keys)
    batch_only(df, "temporal_one")
    batch_only(versions, "temporal_one")
    others = [c for c in versions.columns if c not in keys]
    if not check_overlaps:  # several versions can be valid at once, and each row meets all of them
        copies = {k: unused(f"{k}_version", [*df.columns, *versions.columns]) for k in keys}
        renamed = versions.select(*[F.col(k).alias(c) for k, c in copies.items()], *others)
        on = (F.col(valid_from) <= F.col(at)) & (F.col(valid_to).isNull() | (F.col(at) < F.col(valid_to)))
        for k, c in reversed(copies.items()):
            on = (F.col(k) == F.col(c)) & on
        return df.join(renamed, on, how).drop(*copies.values())
    live = versions.where(F.col(valid_to).isNull() | (F.col(valid_from) < F.col(valid_to)))
    before = unused("before", versions.columns)
    order = Window.partitionBy(*keys).orderBy(valid_from)
    earlier = F.max(F.coalesce(F.col(valid_to), F.lit("9999-12-31").cast("timestamp"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    overlaps = live.withColumn(before, earlier).where(F.col(before) > F.col(valid_from))
    # without overlaps the version that began last is the only one that can be valid
    begin, version = (unused(n, [*df.columns, *keys]) for n in ("begin", "version"))
    found = as_of_one(df, live.select(*keys, F.col(valid_from).alias(begin), F.struct(*others).alias(version)), keys, at, begin, _ordered=False)
    valid = F.col(version).isNotNull() & (F.col(f"{version}.{valid_to}").isNull() | (F.col(at) < F.col(f"{version}.{valid_to}")))
    if how == "inner":
        found = found.where(valid)
    joined = found.select(*df.columns, *[F.when(valid, F.col(f"{version}.{c}")).alias(c) for c in others])
    return _with_guard(joined, overlaps, "OVERLAP", "versions of a key overlap")


def as_of_one(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, *, direction: str = "backward", tolerance: str | None = None, how: str = "left", _ordered: bool = True) -> DataFrame:
    """Each left row with the right row of its keys that is nearest in time: backward the last not after it, forward the first not before it.

    Both sides are put under one another and sorted once by keys and time: no row meets more than its match, so a busy key
    costs a sort and not a product. nearest takes the closer of both and raises where they are equally far. A
    match farther than tolerance (an interval such as '10 minutes') doesn't count. Rows of either side with a null time or key don't match.
    Of right rows with equal keys and times the one with the greatest columns, in order, is the match.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError("direction is backward, forward or nearest")
    batch_only(left, "as_of_one")
    batch_only(right, "as_of_one")
    keys = list(keys)
    extra = [c for c in right.columns if c not in keys]
    payload = F.struct(F.col(right_time).alias("t_"), *[F.col(c) for c in extra if c != right_time])
    r = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("time_"), payload.alias("right_"), F.lit(0).alias("side_"))
    l = left.select(*keys, F.col(left_time).alias("time_"), F.struct(*left.columns).alias("left_"), F.lit(1).alias("side_"))
    both = l.unionByName(r, allowMissingColumns=True)
    tie = [F.asc_nulls_first("right_")] if _ordered else []
    back = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("time_"), "side_", *tie).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc_nulls_first("time_"), "side_", *tie).rowsBetween(Window.unboundedPreceding, 0)
    usable = F.col("time_").isNotNull()
    for k in keys:
        usable &= F.col(k).isNotNull()
    if direction != "forward":
        both = both.withColumn("b_", F.when(usable, F.last("right_", ignorenulls=True).over(back)))
    if direction != "backward":
        both = both.withColumn("f_", F.when(usable, F.last("right_", ignorenulls=True).over(ahead)))
    if direction == "nearest":
        gap = lambda c: F.abs(F.unix_micros(F.col("time_").cast("timestamp")) - F.unix_micros(F.col(f"{c}.t_").cast("timestamp")))
        even = gap("b_").isNotNull() & (gap("b_") == gap("f_")) & (F.col("b_.t_") != F.col("f_.t_")) & (F.col("side_") == 1)
        near = F.when(F.coalesce(even, F.lit(False)), F.raise_error(F.lit("TIE: two rows are equally near")).cast("void")).when(gap("f_").isNull() | (gap("b_") <= gap("f_")), F.col("b_")).otherwise(F.col("f_"))
        match = near
    else:
        match = F.col("b_" if direction == "backward" else "f_")
    rows = both.where("side_ = 1").withColumn("match_", match)
    if tolerance is not None:
        far = F.abs(F.unix_micros(F.col("time_").cast("timestamp")) - F.unix_micros(F.col("match_.t_").cast("timestamp")))
        limit = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {tolerance}"))
        rows = rows.withColumn("match_", F.when(far <= limit, F.col("match_")))
    if how == "inner":
        rows = rows.where(F.col("match_").isNotNull())
    return rows.select("left_.*", *[F.col("match_.t_" if c == right_time else f"match_.{c}").alias(c) for c in extra])


def event_time_between(left: Column, right: Column, *, upper: str, lower: str = "0 seconds") -> Column:
    """right >= left - lower and right <= left + upper."""
    return (right >= left - F.expr(f"INTERVAL {lower}")) & (right <= left + F.expr(f"INTERVAL {upper}"))


def relation_alias(df: DataFrame, name: str) -> DataFrame:
    """A second occurrence of a relation, for self joins."""
    return df.alias(name)
