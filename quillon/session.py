"""The session and the SQL entry point."""

from __future__ import annotations

import logging
import re
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from quillon.plans import dialect
from quillon.sources import tables

log = logging.getLogger("quillon")

#: What results depend on; sizes (shuffle partitions, memory) are the cluster's to set.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(app: str = "quillon", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; conf adds to them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def whole_divisions(df: DataFrame, query: str) -> list[int]:
    """Where query has a `/` whose operands both are integers, as the analysed plan types them."""
    spark = df.sparkSession
    chosen = spark._jvm.org.apache.spark.sql.catalyst.expressions.Cast.USER_SPECIFIED_CAST()
    whole = ("tinyint", "smallint", "int", "bigint")
    listed = lambda seq: [seq.apply(k) for k in range(seq.size())]
    kind = lambda node: node.getClass().getSimpleName()
    found: set[int] = set()

    def operand(e):
        """What stands in the text, without the cast that `/` adds."""
        return e.child() if kind(e) == "Cast" and e.getTagValue(chosen).isEmpty() else e

    def expression(e) -> None:
        if kind(e) == "Divide":
            a, b = operand(e.left()), operand(e.right())
            text, first, last = e.origin().sqlText(), e.origin().startIndex(), e.origin().stopIndex()
            if text.isDefined() and text.get() == query and first.isDefined() and last.isDefined() and all(x.dataType().catalogString() in whole for x in (a, b)):
                at = dialect.last_division(query[first.get() : last.get() + 1])
                if at >= 0:
                    found.add(first.get() + at)
        if hasattr(e, "plan") and "Subquery" in kind(e) or kind(e) in ("Exists", "ListQuery"):
            plan(e.plan())
        for child in listed(e.children()):
            expression(child)

    def plan(node) -> None:
        for e in listed(node.expressions()):
            expression(e)
        for child in listed(node.children()):
            plan(child)

    plan(df._jdf.queryExecution().analyzed())
    return sorted(found)


class Engine:
    """SQL over registered tables, in PostgreSQL's dialect, planned by Catalyst."""

    def __init__(self, spark: SparkSession, sf_dir: str | None = None):
        self.spark = spark
        self.prepared: dict[str, str] = {}
        if sf_dir:
            self.load(sf_dir)

    def load(self, sf_dir: str, names: Sequence[str] | None = None) -> Engine:
        """Register the tables of a folder as views; with no names, the tables of SCHEMAS."""
        for name in names or tables.SCHEMAS:
            self.register(name, tables.scan(self.spark, sf_dir, name))
        return self

    def register(self, name: str, df: DataFrame) -> Engine:
        df.createOrReplaceTempView(name)
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def integer_columns(self, text: str) -> set[str]:
        """Names that are integer columns in every view that the text names and that has them."""
        words = set(re.findall(r"[a-z_]\w*", text.lower()))
        kinds: dict[str, set[bool]] = {}
        for view in self.spark.catalog.listTables():
            if view.name.lower() in words:
                for field in self.spark.table(view.name).schema.fields:
                    kinds.setdefault(field.name.lower(), set()).add(field.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"))
        return {name for name, k in kinds.items() if k == {True}}

    def resolves(self, query: str) -> bool:
        """Whether the query is complete in itself: it refers to no outer query, parameter or WITH table."""
        try:
            return len(self.spark.sql(query).columns) == 1
        except AnalysisException:
            return False

    def sql(self, text: str, args: Mapping | Sequence | None = None) -> DataFrame:
        """One statement: a query, or PREPARE, EXECUTE and DEALLOCATE of one. args: values of $1, $2 ... or of :name."""
        text = text.strip().rstrip(";").strip()
        if m := re.match(r"(?is)prepare\s+(\w+)\s*(?:\([^)]*\))?\s+as\s+(.*)", text):
            self.prepared[m[1].lower()] = m[2]
            return self.spark.range(0).select()
        if m := re.match(r"(?is)execute\s+(\w+)\s*(?:\((.*)\))?$", text):
            return self._run(dialect.bound(self.prepared[m[1].lower()], dialect.arguments(m[2] or "")), None)
        if m := re.match(r"(?is)deallocate\s+(?:prepare\s+)?(\w+)$", text):
            del self.prepared[m[1].lower()]
            return self.spark.range(0).select()
        return self._run(text, args)

    def _run(self, text: str, args: Mapping | Sequence | None) -> DataFrame:
        query = dialect.translate(text, self.integer_columns(text) if "/" in text else set(), self.resolves)
        while True:  # divisions of divisions are known to be of integers once the inner ones are
            log.debug("%s", query)
            df = self._planned(query, args)
            places = whole_divisions(df, query) if "/" in query else []
            if not places:
                return df
            for at in sorted(places, reverse=True):
                query = f"{query[:at]}DIV{query[at + 1 :]}"

    def _planned(self, query: str, args: Mapping | Sequence | None) -> DataFrame:
        if args is None:
            return self.spark.sql(query)
        return self.spark.sql(query, args=dict(args) if isinstance(args, Mapping) else {f"p{k}": a for k, a in enumerate(args, 1)})

    def explain(self, text: str, mode: str = "formatted") -> str:
        """The physical plan of a query as text."""
        jvm = self.spark._jvm
        return self.sql(text)._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
