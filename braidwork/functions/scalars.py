"""Scalar columns: strings, hashes, dates, numbers, null control, predicates and conversions.

What Spark has under the same name and meaning is passed on; keyword forms with literal arguments are defined here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import (  # noqa: F401
    abs, base64, bround, ceil, coalesce, concat_ws, date_add, date_sub, datediff, dayofmonth, exp, floor, hash, hour, ifnull, initcap, isnan,
    isnotnull, isnull, length, levenshtein, lower, ltrim, md5, minute, month, nanvl, nullif, nvl, nvl2, pow, reverse, round, rtrim, second, sha1,
    sha2, signum, sqrt, to_date, to_timestamp, trim, unbase64, upper, when, xxhash64, year, zeroifnull,
)

literal = F.lit


def substring(value, *, start: int, length: int) -> Column:
    """length characters from the 1-based start."""
    return F.substring(value, start, length)


def split(value, *, pattern: str, limit: int = -1) -> Column:
    return F.split(value, pattern, limit)


def regexp_replace(value, *, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(value, pattern, replacement)


def regexp_extract(value, *, pattern: str, group: int = 1) -> Column:
    """The group of the first match, "" where there is none."""
    return F.regexp_extract(value, pattern, group)


def translate(value, *, matching: str, replacement: str) -> Column:
    return F.translate(value, matching, replacement)


def instr(value, *, substring: str) -> Column:
    """1-based place, 0 where absent."""
    return F.instr(value, substring)


def encode(value, *, charset: str = "UTF-8") -> Column:
    return F.encode(value, charset)


def decode(value, *, charset: str = "UTF-8") -> Column:
    return F.decode(value, charset)


def date_trunc(value, *, unit: str) -> Column:
    return F.date_trunc(unit, value)


def trunc(value, *, unit: str) -> Column:
    return F.trunc(value, unit)


def log(value, *, base: float | None = None) -> Column:
    """Natural logarithm, or to the base."""
    return F.log(value) if base is None else F.log(float(base), value)


def to_decimal(value, *, precision: int, scale: int) -> Column:
    if not 1 <= precision <= 38 or not 0 <= scale <= precision:
        raise ValueError("needs 1 <= precision <= 38 and 0 <= scale <= precision")
    return _column(value).cast(f"decimal({precision},{scale})")


def null_safe_eq(left, right) -> Column:
    return _column(left).eqNullSafe(right)


def between(value, lower, upper) -> Column:
    """Both ends belong to it."""
    value = _column(value)
    return (value >= lower) & (value <= upper)


def isin(value, *values) -> Column:
    if not values:
        raise ValueError("isin needs a value")
    return _column(value).isin(*values)


def try_cast(value, target: str) -> Column:
    """null where the cast fails."""
    return _column(value).try_cast(target)


def bitwise_and(left, right) -> Column:
    return _column(left).bitwiseAND(right)


def bitwise_or(left, right) -> Column:
    return _column(left).bitwiseOR(right)


def bitwise_xor(left, right) -> Column:
    return _column(left).bitwiseXOR(right)


def bitwise_not(value) -> Column:
    return F.bitwise_not(value)


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
