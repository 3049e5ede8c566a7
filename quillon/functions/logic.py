"""Three-valued logic and membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_true(e: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(e, F.lit(False))


def one_of(e: Column, values: Sequence) -> Column:
    """IN a list; nulls in the list are ignored, an empty list matches nothing."""
    some = [v for v in values if v is not None]
    return e.isin(some) if some else F.lit(False)


def none_of(e: Column, values: Sequence) -> Column:
    some = [v for v in values if v is not None]
    return ~e.isin(some) if some else F.lit(True)


def case(*branches: tuple[Column, Column], otherwise: Column | None = None) -> Column:
    """The value of the first true branch, else otherwise (null)."""
    out = F.when(*branches[0])
    for condition, value in branches[1:]:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def case_of(e: Column, *branches: tuple[Column, Column], otherwise: Column | None = None) -> Column:
    """CASE e WHEN value: null matches nothing."""
    return case(*((e == v, r) for v, r in branches), otherwise=otherwise)
