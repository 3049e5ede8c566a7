"""Plans as text: a JSON document of nested operators, run through the plan builder.

{"op": "scan", "table": "nation"} is a leaf; other operators have "input" (and "right"), and the names of
their arguments are those of the builder's methods.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from quillon.plans.rel import Rel

UNARY = {
    "where": lambda r, n: r.where(n["condition"]),
    "map": lambda r, n: r.map(**n["columns"]),
    "project": lambda r, n: r.project(*n.get("columns", ()), **n.get("computed", {})),
    "rename": lambda r, n: r.rename(**n["names"]),
    "distinct": lambda r, n: r.distinct(*n.get("columns", ())),
    "aggregate": lambda r, n: r.aggregate(n.get("by", ()), n.get("having"), **n["aggregates"]),
    "sort": lambda r, n: r.sort(*(tuple(k) if isinstance(k, list) else k for k in n["keys"])),
    "limit": lambda r, n: r.limit(n["n"], n.get("offset", 0)),
    "topk": lambda r, n: r.topk(n["n"], *(tuple(k) if isinstance(k, list) else k for k in n["keys"])),
    "tmp": lambda r, n: r.tmp(),
    "alias": lambda r, n: r.alias(n["name"]),
}
BINARY = {
    "cross": lambda a, b, n: a.cross(b),
    "join": lambda a, b, n: a.join(b, n["on"], n.get("kind", "inner")),
    "mark_join": lambda a, b, n: a.mark_join(b, n["mark"], n["on"]),
    "single_join": lambda a, b, n: a.single_join(b, n["on"]),
    "collection_join": lambda a, b, n: a.collection_join(b, n["on"], n["into"], n["columns"]),
    "union": lambda a, b, n: a.union(b, n.get("all", False)),
    "intersect": lambda a, b, n: a.intersect(b, n.get("all", False)),
    "except": lambda a, b, n: a.except_(b, n.get("all", False)),
}


def build(spark: SparkSession, node: dict, sf_dir: str | None = None) -> Rel:
    op = node["op"]
    if op == "scan":
        return Rel.scan(spark, sf_dir, node["table"], node.get("columns")) if sf_dir else Rel(spark.table(node["table"]))
    if op == "values":
        return Rel.values(spark, node["schema"], node["rows"])
    if op in UNARY:
        return UNARY[op](build(spark, node["input"], sf_dir), node)
    if op in BINARY:
        return BINARY[op](build(spark, node["input"], sf_dir), build(spark, node["right"], sf_dir), node)
    raise ValueError(f"no such operator: {op}")


def run(spark: SparkSession, text: str, sf_dir: str | None = None) -> DataFrame:
    """The result of a plan text; tables come from sf_dir, else from the session's views."""
    return build(spark, json.loads(text), sf_dir).materialize()
