"""String semantics: LIKE with an escape, substrings from before the start, blank-padded comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def like(e: Column, pattern: str, escape: str = "\\") -> Column:
    """% any run, _ one character."""
    return F.like(e, F.lit(pattern), F.lit(escape))


def not_like(e: Column, pattern: str, escape: str = "\\") -> Column:
    return ~like(e, pattern, escape)


def substring(e: Column, start: int, length: int | None = None) -> Column:
    """1-based; a start before 1 counts as 1 and leaves the length as it is."""
    start = max(start, 1)
    return F.substring(e, start, length) if length is not None else F.substring(e, F.lit(start), F.length(e))


def padded_equal(e: Column, value: str) -> Column:
    """Equality of a CHAR(n) column: trailing blanks do not count."""
    return F.rtrim(e) == value.rstrip(" ")


def padded_in(e: Column, values: list[str]) -> Column:
    return F.rtrim(e).isin([v.rstrip(" ") for v in values])


def char(e: Column, n: int) -> Column:
    """The stored form of CHAR(n): padded with blanks."""
    return F.rpad(e, n, " ")


def concat(*parts: Column) -> Column:
    """||: null if any part is."""
    return F.concat(*parts)
