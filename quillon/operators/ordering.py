"""Order with PostgreSQL's places of nulls, and checks of limits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def keys(items: Iterable) -> list[Column]:
    """Sort keys: nulls last ascending, first descending; (key, 'asc'|'desc'[, 'first'|'last']) says otherwise."""
    out = []
    for item in items:
        e, direction, *nulls = item if isinstance(item, tuple) else (item, "asc")
        c = F.expr(e) if isinstance(e, str) else e
        place = nulls[0] if nulls else "last" if direction == "asc" else "first"
        out.append(getattr(c, f"{direction}_nulls_{place}")())
    return out


def check(n: int, offset: int) -> None:
    if n < 0 or offset < 0:
        raise ValueError("LIMIT and OFFSET must not be negative")
