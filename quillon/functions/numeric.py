"""Number semantics: integer division, decimals of bounded scale that truncate, casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest precision and scale of decimal results; fixed values.
MAX_PRECISION, MAX_SCALE = 32, 6


def add_type(p1: int, s1: int, p2: int, s2: int) -> tuple[int, int]:
    return min(max(p1 - s1, p2 - s2) + max(s1, s2), MAX_PRECISION), min(max(s1, s2), MAX_SCALE)


def mul_type(p1: int, s1: int, p2: int, s2: int) -> tuple[int, int]:
    return min(p1 + p2, MAX_PRECISION), min(s1 + s2, MAX_SCALE)


def div_type(p1: int, s1: int, p2: int, s2: int) -> tuple[int, int]:
    return max(p1, p2), max(s1, s2)


def int_div(a: Column, b: Column, kind: str = "int") -> Column:
    """Integer division towards zero, in the operands' type."""
    return ((a - a % b) / b).cast(kind)


def trunc_to(e: Column, scale: int, precision: int = 38) -> Column:
    """A decimal with its digits after scale cut off."""
    power = F.lit(10**scale).cast("decimal(20,0)")
    cut = F.when(e >= 0, F.floor(e * power)).otherwise(F.ceil(e * power))
    return (cut.cast("decimal(38,0)") / power).cast(f"decimal({precision},{scale})")


def mul_trunc(a: Column, b: Column, scale: int = MAX_SCALE) -> Column:
    """A decimal product with at most scale digits, cut off."""
    return trunc_to(a * b, scale)


def div_trunc(a: Column, b: Column, scale: int = MAX_SCALE) -> Column:
    """A decimal quotient with at most scale digits, cut off, not rounded; null for a divisor of zero."""
    x = a.cast("decimal(26,6)") * F.lit(10**scale).cast("decimal(8,0)")
    divisor = F.nullif(b.cast("decimal(20,6)"), F.lit(0).cast("decimal(20,6)"))
    whole = ((x - x % divisor) / divisor).cast("decimal(32,0)")  # divides without a rest
    return (whole * F.lit(f"1e-{scale}").cast(f"decimal({scale + 1},{scale})")).cast(f"decimal(38,{scale})")


def to_int(e: Column, kind: str = "int") -> Column:
    """A number as an integer, cut towards zero."""
    return e.cast(kind)


def modulo(a: Column, b: Column) -> Column:
    """The remainder, with the dividend's sign."""
    return a % b
