"""User functions over Arrow batches, for what built-in functions can't say."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scalar(return_type: str) -> Callable:
    """A function of single values as a column function. Batches travel by Arrow; nulls are passed as None."""

    def wrap(function: Callable):
        return F.udf(function, return_type, useArrow=True)

    return wrap


def vectorised(return_type: str) -> Callable:
    """A function of pandas series as a column function; the faster one where numpy can do the work."""

    def wrap(function: Callable[..., pd.Series]):
        return F.pandas_udf(function, return_type)

    return wrap


def hook(df: DataFrame, function: Callable[..., DataFrame], *others: DataFrame) -> DataFrame:
    """Any function of relations as a step."""
    return function(df, *others)
