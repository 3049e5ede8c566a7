"""A fluent plan builder: relational operators over DataFrames, with SQL's semantics and PostgreSQL's null order.

Every method is lazy and declares what is wanted; Catalyst picks the physical plan.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import joins, ordering
from quillon.sources import tables

Expr = str | Column


def expr(e: Expr) -> Column:
    return F.expr(e) if isinstance(e, str) else e


class Rel:
    """A relation under construction."""

    def __init__(self, df: DataFrame):
        self.df = df

    # sources

    @classmethod
    def scan(cls, spark: SparkSession, sf_dir: str, table: str, columns: Sequence[str] | None = None) -> Rel:
        df = tables.scan(spark, sf_dir, table)
        return cls(df.select(*columns) if columns else df)

    @classmethod
    def values(cls, spark: SparkSession, schema: str, rows: Sequence[Sequence]) -> Rel:
        return cls(tables.values(spark, schema, rows))

    @classmethod
    def result(cls, spark: SparkSession, **columns: Expr) -> Rel:
        """One row of expressions: a query without FROM."""
        return cls(tables.one_row(spark).select(*(expr(e).alias(n) for n, e in columns.items())))

    # one input

    def where(self, condition: Expr) -> Rel:
        """Rows for which the condition is true (not null)."""
        return Rel(self.df.where(expr(condition)))

    def map(self, **columns: Expr) -> Rel:
        """Computed columns beside the others."""
        return Rel(self.df.withColumns({n: expr(e) for n, e in columns.items()}))

    def project(self, *columns: str, **computed: Expr) -> Rel:
        return Rel(self.df.select(*columns, *(expr(e).alias(n) for n, e in computed.items())))

    def rename(self, **new_to_old: str) -> Rel:
        return Rel(self.df.withColumnsRenamed({old: new for new, old in new_to_old.items()}))

    def alias(self, name: str) -> Rel:
        """A scope for a self-join: columns are then name.column."""
        return Rel(self.df.alias(name))

    def distinct(self, *columns: str) -> Rel:
        """Distinct rows (of the columns, if given); nulls are equal."""
        return Rel((self.df.select(*columns) if columns else self.df).distinct())

    def aggregate(self, by: Sequence[str] | Mapping[str, Expr] = (), having: Expr | None = None, **aggregates: Expr) -> Rel:
        """Groups by columns or named expressions; without any, one row always."""
        keys = [expr(e).alias(n) for n, e in by.items()] if isinstance(by, Mapping) else [F.col(c) for c in by]
        out = self.df.groupBy(*keys).agg(*(expr(e).alias(n) for n, e in aggregates.items()))
        return Rel(out.where(expr(having)) if having is not None else out)

    def sort(self, *keys: Expr) -> Rel:
        """Keys are columns, expressions or (expression, 'asc' | 'desc'); nulls last ascending, first descending."""
        return Rel(self.df.orderBy(*ordering.keys(keys)))

    def limit(self, n: int, offset: int = 0) -> Rel:
        ordering.check(n, offset)
        return Rel((self.df.offset(offset) if offset else self.df).limit(n))

    def topk(self, n: int, *keys: Expr) -> Rel:
        """The first n rows in order: each task keeps n rows, and no global sort is made."""
        return self.sort(*keys).limit(n)

    def tmp(self) -> Rel:
        """Worked out once for several consumers: written below the shared folder and read again, so no executor's loss costs it."""
        path = f"{tables.work_dir(self.df.sparkSession)}/tmp-{uuid.uuid4().hex}"
        tables.write(self.df, path)
        return Rel(self.df.sparkSession.read.schema(self.df.schema).parquet(path))

    # two inputs

    def cross(self, other: Rel) -> Rel:
        return Rel(self.df.crossJoin(other.df))

    def join(self, other: Rel, on: Expr | Sequence[str], kind: str = "inner") -> Rel:
        """kind: inner, left, right, full, semi, anti, right_semi, right_anti."""
        return Rel(joins.join(self.df, other.df, on if not isinstance(on, str) else expr(on), kind))

    def mark_join(self, other: Rel, mark: str, on: Sequence[str] | Expr) -> Rel:
        return Rel(joins.mark_join(self.df, other.df, mark, on if not isinstance(on, str) else expr(on)))

    def single_join(self, other: Rel, on: Sequence[str]) -> Rel:
        return Rel(joins.single_join(self.df, other.df, on))

    def collection_join(self, other: Rel, on: Sequence[str], into: str, columns: Sequence[str]) -> Rel:
        return Rel(joins.collection_join(self.df, other.df, on, into, columns))

    def union(self, other: Rel, all: bool = False) -> Rel:
        both = self.df.union(other.df)
        return Rel(both if all else both.distinct())

    def intersect(self, other: Rel, all: bool = False) -> Rel:
        return Rel(self.df.intersectAll(other.df) if all else self.df.intersect(other.df))

    def except_(self, other: Rel, all: bool = False) -> Rel:
        return Rel(self.df.exceptAll(other.df) if all else self.df.subtract(other.df))

    # sinks

    def materialize(self, *columns: str, names: Sequence[str] | None = None) -> DataFrame:
        """The result, with the columns named, under other names if given."""
        df = self.df.select(*columns) if columns else self.df
        return df.toDF(*names) if names else df
