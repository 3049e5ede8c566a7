"""Join families. Equality keys let Spark choose broadcast or shuffle by size, and split skewed keys at run time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPARK = {"inner": "inner", "left": "left_outer", "right": "right_outer", "full": "full_outer", "semi": "left_semi", "anti": "left_anti"}


def join(left: DataFrame, right: DataFrame, on: Column | Sequence[str], kind: str = "inner") -> DataFrame:
    """on: a condition, or names of columns that both sides have (kept once)."""
    if kind in ("right_semi", "right_anti"):
        return join(right, left, on, kind.removeprefix("right_"))
    return left.join(right, on if isinstance(on, Column) else [*on], SPARK[kind])


def null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> Column:
    """Equality of keys in which null equals null."""
    out = F.lit(True)
    for c in on:
        out = out & left[c].eqNullSafe(right[c])
    return out


def mark_join(left: DataFrame, right: DataFrame, mark: str, on: Column | Sequence[str]) -> DataFrame:
    """left with a boolean column: whether right has a match.

    With key names, right's distinct keys are joined once; with a condition, the distinct rows of left that
    have a match are, so left's rows are never multiplied, and nothing depends on the order of rows."""
    if not isinstance(on, Column):
        keys = right.select(*on).distinct().withColumn(mark, F.lit(True))
        return left.join(keys, [*on], "left_outer").withColumn(mark, F.coalesce(mark, F.lit(False)))
    hit = left.join(right, on, "left_semi").distinct().toDF(*(f"__hit{k}" for k in range(len(left.columns)))).withColumn("__hit", F.lit(True))
    same = F.lit(True)
    for k, c in enumerate(left.columns):
        same = same & left[c].eqNullSafe(F.col(f"__hit{k}"))
    joined = left.join(hit, same, "left_outer")
    return joined.select(*(left[c] for c in left.columns), F.coalesce("__hit", F.lit(False)).alias(mark))


def single_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """A left join in which right has at most one row a key; more raise an error."""
    counted = right.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"), *(F.any_value(c).alias(c) for c in right.columns if c not in on))
    checked = counted.where(F.when(F.col("__n") > 1, F.raise_error(F.lit("more than one row for a key of a single join"))).otherwise(F.lit(True)).cast("boolean"))
    return left.join(checked.drop("__n"), [*on], "left_outer")


def collection_join(left: DataFrame, right: DataFrame, on: Sequence[str], into: str, columns: Sequence[str]) -> DataFrame:
    """left with a list of the matching rows of right (empty without a match), in the order of their columns."""
    lists = right.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(into))
    joined = left.join(lists, [*on], "left_outer")
    return joined.withColumn(into, F.coalesce(into, F.array().cast(joined.schema[into].dataType)))


def salted(left: DataFrame, right: DataFrame, on: Sequence[str], salts: int, kind: str = "inner") -> DataFrame:
    """For a known hot key: left's rows are dealt over salts parts and right's are copied to each (inner, left, semi, anti).

    The salt is a hash of left's other columns, the same when a task is run again and whatever the partitioning; rows that are equal in all columns stay together."""
    if kind not in ("inner", "left", "semi", "anti"):
        raise ValueError("right's rows are copied, so kinds that keep them cannot be salted")
    a = left.withColumn("__salt", F.pmod(F.xxhash64(*(c for c in left.columns if c not in on)), F.lit(salts)))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, "__salt"], SPARK[kind]).drop("__salt")
