"""Dates, timestamps and intervals, by the calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(field: str, e: Column) -> Column:
    """year, month or day as a bigint."""
    if field not in ("year", "month", "day"):
        raise ValueError(f"no such field: {field}")
    return {"year": F.year, "month": F.month, "day": F.dayofmonth}[field](e).cast("bigint")


def add(e: Column, years: int = 0, months: int = 0, days: int = 0) -> Column:
    """A date moved by an interval; months end where they end."""
    return F.date_add(F.add_months(e, 12 * years + months), days)


def subtract(e: Column, years: int = 0, months: int = 0, days: int = 0) -> Column:
    return add(e, -years, -months, -days)
