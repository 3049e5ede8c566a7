"""Aggregates whose results SQL engines define exactly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import numeric


def exact_sum(e: Column, scale: int = 2, precision: int = 18) -> Column:
    """The sum of doubles that hold decimals, without an order's rounding."""
    return F.sum(e.cast(f"decimal({precision},{scale})"))


def average(e: Column, scale: int = 6) -> Column:
    """sum / count as a decimal whose further digits are cut off, as for integers and decimals in the compiled engine."""
    total = F.sum(e.cast(f"decimal(32,{scale})"))
    return numeric.div_trunc(total, F.count(e), scale)


def grouped_distinct(df: DataFrame, keys: Sequence[str], column: str, **aggregates) -> DataFrame:
    """Aggregates over the distinct values of a column: two partial aggregations and one exchange a level."""
    return df.select(*keys, column).distinct().groupBy(*keys).agg(*(f(column).alias(n) for n, f in aggregates.items()))


def dependent(df: DataFrame, key: str, passthrough: Sequence[str], **aggregates: Column) -> DataFrame:
    """Groups by key; columns that depend on it are carried along by any value instead of widening the key."""
    return df.groupBy(key).agg(*(F.any_value(c).alias(c) for c in passthrough), *(e.alias(n) for n, e in aggregates.items()))
