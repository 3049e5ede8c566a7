"""Scans, projections, joins, aggregates, orders, set operations and subqueries, each with its SQL twin."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import registry
from quillon.operators import aggregates, joins
from quillon.plans import textual
from quillon.plans.rel import Rel
from quillon.session import Engine
from quillon.sources import tables


class Tables:
    """Relations over a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str, *columns: str) -> Rel:
        return Rel.scan(self.spark, self.sf_dir, name, columns or None)


def rel(name: str, sql: str) -> Callable:
    """Registers a query that builds a Rel (or DataFrame) from the tables."""

    def wrap(f: Callable[[Tables], Rel | DataFrame]) -> Callable:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            return out.df if isinstance(out, Rel) else out

        registry.add(name, query, sql)
        return f

    return wrap


def sql(name: str, text: str, twin: str | None = None) -> None:
    """Registers a query that goes through the SQL front; the twin is the same text if that gives the same types."""
    named = [x for x in tables.SCHEMAS if re.search(rf"\b{x}\b", text)]
    registry.add(name, lambda spark, sf_dir: Engine(spark).load(sf_dir, named).sql(text), twin or text)


# 2.1 scans, sources, sinks


@rel("s1_seq_scan", "select l_orderkey, l_linenumber, l_quantity * 2 as twice from lineitem where l_quantity < 5")
def _(t):
    return t("lineitem").where("l_quantity < 5").project("l_orderkey", "l_linenumber", twice="l_quantity * 2")


@rel("s2_index_scan", "select o_orderkey, o_totalprice from orders where o_orderkey = 42")
def _(t):
    return t("orders", "o_orderkey", "o_totalprice").where("o_orderkey = 42")  # an equality on the key prunes row groups


@rel("s3_index_only_scan", "select c_custkey from customer where c_custkey between 10 and 20")
def _(t):
    return t("customer", "c_custkey").where("c_custkey between 10 and 20")


@rel("s4_bitmap_scan", "select p_partkey, p_size from part where p_size = 7 or p_size = 9")
def _(t):
    return t("part", "p_partkey", "p_size").where("p_size = 7 or p_size = 9")


sql("s5_subquery_scan", "select x.k, x.n from (select n_regionkey as k, n_name as n from nation) x where x.k > 1")
sql("s6_cte_scan", "with big as (select o_custkey, o_totalprice from orders where o_totalprice > 300000) select a.o_custkey, count(*) as n from big a join big b on a.o_custkey = b.o_custkey group by a.o_custkey")


@rel("s7_required_columns", "select l_returnflag from lineitem where l_discount = 0.05")
def _(t):
    return t("lineitem").where("l_discount = 0.05").project("l_returnflag")


@rel("s8_typed_reader", "select o_orderkey, cast(o_totalprice as decimal(12,2)) as price, o_orderdate, o_orderstatus from orders")
def _(t):
    return t("orders").project("o_orderkey", price="cast(o_totalprice as decimal(12,2))", o_orderdate="o_orderdate", o_orderstatus="o_orderstatus")


@rel("s9_const_relation", "select * from (values (1, 'a'), (2, 'b'), (3, null)) v(id, name)")
def _(t):
    return Rel.values(t.spark, "id int, name string", [(1, "a"), (2, "b"), (3, None)])


@rel("s10_result", "select 1 as one, 'x' || 'y' as xy")
def _(t):
    return Rel.result(t.spark, one="1", xy="'x' || 'y'")


@rel("s11_materialize", "select r_regionkey as id, r_name as region from region")
def _(t):
    return t("region").materialize("r_regionkey", "r_name", names=["id", "region"])


@rel("s12_types_out", "select l_linenumber = 1 as b, cast(l_linenumber as smallint) as i2, l_linenumber as i4, l_orderkey as i8, cast(l_tax as float) as f4, l_tax as f8, cast(l_extendedprice as decimal(12,2)) as d, l_returnflag as s, cast(l_shipdate as date) as dt from lineitem")
def _(t):
    return t("lineitem").project(b="l_linenumber = 1", i2="cast(l_linenumber as smallint)", i4="l_linenumber", i8="l_orderkey", f4="cast(l_tax as float)", f8="l_tax", d="cast(l_extendedprice as decimal(12,2))", s="l_returnflag", dt="cast(l_shipdate as date)")


@rel("s13_tmp", "with m as (select o_custkey, max(o_orderkey) as k from orders group by o_custkey) select a.o_custkey, a.k from m a join m b on a.k = b.k")
def _(t):
    m = t("orders").aggregate(["o_custkey"], k="max(o_orderkey)").tmp()  # worked out once, read twice
    return m.join(m.project(k="k"), ["k"]).project("o_custkey", "k")


@rel("s15_delimited_dump", "select r_regionkey, r_name from region")
def _(t):
    path = f"{tables.work_dir(t.spark)}/region-dump"
    tables.write(t("region").df, path, "csv", mode="overwrite", sep="|")
    return tables.scan_delimited(t.spark, path, "r_regionkey int, r_name string")


# 2.2 projection, filter


@rel("p1_selection_null_drops", "select o_orderkey from orders where nullif(o_orderstatus, 'P') = 'F'")
def _(t):
    return t("orders").where("nullif(o_orderstatus, 'P') = 'F'").project("o_orderkey")


@rel("p2_map", "select p_partkey, p_size + 1 as next, p_name || '!' as loud from part")
def _(t):
    return t("part").map(next="p_size + 1", loud="p_name || '!'").project("p_partkey", "next", "loud")


@rel("p3_projection", "select n_name, n_nationkey from nation")
def _(t):
    return t("nation").project("n_name", "n_nationkey")


@rel("p4_projection_distinct", "select distinct o_orderstatus, o_orderpriority from orders")
def _(t):
    return t("orders").distinct("o_orderstatus", "o_orderpriority")


@rel("p5_renaming", "select n_nationkey as key, n_name as name, n_regionkey as region from nation")
def _(t):
    return t("nation").rename(key="n_nationkey", name="n_name", region="n_regionkey")


@rel("p6_join_projection", "select s_name, n_name from supplier join nation on s_nationkey = n_nationkey")
def _(t):
    return t("supplier").join(t("nation"), "s_nationkey = n_nationkey").project("s_name", "n_name")


sql("p7_expression_arguments", "select l_returnflag, sum(l_linenumber * 2 + 1) as s from lineitem group by l_returnflag order by sum(l_linenumber * 2 + 1)", "select l_returnflag, cast(sum(l_linenumber * 2 + 1) as bigint) as s from lineitem group by l_returnflag")
sql("p8_select_distinct", "select distinct nullif(c_mktsegment, 'BUILDING') as segment from customer")


@rel("p9_exchange_is_transparent", "select count(*) as n from customer")
def _(t):
    return Rel(t("customer").df.repartition(4)).aggregate(n="count(*)")


@rel("p10_column_access", "select o_custkey as k, o_custkey as again, o_orderkey + o_custkey as s, o_orderkey > o_custkey as g from orders")
def _(t):
    return t("orders").project(k="o_custkey", again=F.col("o_custkey"), s=F.col("o_orderkey") + F.col("o_custkey"), g="o_orderkey > o_custkey")


# 2.3 joins

NULLABLE = "nullif(n_regionkey, 3)"


@rel("j1_cross", "select r_name, n_name from region cross join nation")
def _(t):
    return t("region", "r_name").cross(t("nation", "n_name"))


@rel("j2_inner", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_acctbal > 5000")
def _(t):
    return t("orders").join(t("customer").where("c_acctbal > 5000"), "o_custkey = c_custkey").project("o_orderkey", "c_name")


@rel("j3_theta", "select a.n_nationkey as x, b.n_nationkey as y from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey <> b.n_regionkey")
def _(t):
    a, b = t("nation").alias("a"), t("nation").alias("b")
    return a.join(b, "a.n_nationkey < b.n_nationkey and a.n_regionkey <> b.n_regionkey").project(x="a.n_nationkey", y="b.n_nationkey")


@rel("j4_hash_join", "select l_orderkey, l_linenumber, p_brand from lineitem join part on l_partkey = p_partkey and l_quantity > p_size")
def _(t):
    return t("lineitem").join(t("part"), "l_partkey = p_partkey and l_quantity > p_size").project("l_orderkey", "l_linenumber", "p_brand")


@rel("j5_merge_join", "select l_orderkey, o_orderdate, l_linenumber from lineitem join orders on l_orderkey = o_orderkey")
def _(t):
    return Rel(t("lineitem").df.hint("merge")).join(t("orders"), "l_orderkey = o_orderkey").project("l_orderkey", "o_orderdate", "l_linenumber")


sql("j6_nest_loop_parameter", "select n_nationkey, (select count(*) from supplier where s_nationkey = n_nationkey and s_acctbal > n_regionkey * 1000) as n from nation")


@rel("j7_left_outer", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 300000")
def _(t):
    return t("customer").join(t("orders").where("o_totalprice > 300000"), "c_custkey = o_custkey", "left").project("c_custkey", "o_orderkey")


@rel("j8_right_outer", "select s_suppkey, n_name from supplier right join nation on s_nationkey = n_nationkey and s_acctbal > 9000")
def _(t):
    return t("supplier").where("s_acctbal > 9000").join(t("nation"), "s_nationkey = n_nationkey", "right").project("s_suppkey", "n_name")


@rel("j9_outer_unmatched_only", "select c_custkey from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'P' where o_orderkey is null")
def _(t):
    return t("customer").join(t("orders").where("o_orderstatus = 'P'"), "c_custkey = o_custkey", "left").where("o_orderkey is null").project("c_custkey")


@rel("j10_full_outer", "select r_name, n_name from region full join (select n_name, nullif(n_regionkey, 3) as k from nation) x on r_regionkey = k and r_regionkey <> 1")
def _(t):
    return t("region").join(t("nation").map(k=NULLABLE), "r_regionkey = k and r_regionkey <> 1", "full").project("r_name", "n_name")


@rel("j11_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def _(t):
    return t("customer").join(t("orders").where("o_orderstatus = 'P'"), "c_custkey = o_custkey", "semi").project("c_custkey")


@rel("j12_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def _(t):
    return t("customer").join(t("orders").where("o_orderstatus = 'P'"), "c_custkey = o_custkey", "anti").project("c_custkey")


@rel("j13_right_anti", "select n_nationkey from nation where not exists (select 1 from supplier where s_nationkey = n_nationkey and s_acctbal > 8000)")
def _(t):
    return t("supplier").where("s_acctbal > 8000").join(t("nation"), "s_nationkey = n_nationkey", "right_anti").project("n_nationkey")


@rel("j14_right_semi", "select n_nationkey from nation where exists (select 1 from supplier where s_nationkey = n_nationkey and s_acctbal > 8000)")
def _(t):
    return t("supplier").where("s_acctbal > 8000").join(t("nation"), "s_nationkey = n_nationkey", "right_semi").project("n_nationkey")


@rel("j15_single_join", "select n_name, (select r_name from region where r_regionkey = n_regionkey) as r_name from nation")
def _(t):
    return t("nation").join(t("nation"), ["n_nationkey", "n_name", "n_regionkey"], "semi").rename(r_regionkey="n_regionkey").single_join(t("region"), ["r_regionkey"]).project("n_name", "r_name")


sql("j16_constant_single_join", "select o_orderkey from orders where o_totalprice > (select 0.95 * max(o_totalprice) from orders)", "select o_orderkey from orders where o_totalprice > (select cast(0.95 as double) * max(o_totalprice) from orders)")


@rel("j17_mark_join", "select c_custkey, c_custkey in (select o_custkey from orders where o_totalprice > 350000) as rich from customer")
def _(t):
    return t("customer").mark_join(t("orders").where("o_totalprice > 350000").rename(c_custkey="o_custkey"), "rich", ["c_custkey"]).project("c_custkey", "rich")


sql("j17_mark_join_in_or", "select c_custkey from customer where c_acctbal > 9000 or c_custkey in (select o_custkey from orders where o_totalprice > 350000)")


@rel("j18_collection_join", "select r_name, coalesce(list(n_name order by n_name), []) as nations from region left join nation on r_regionkey = n_regionkey and n_nationkey > 12 group by r_name")
def _(t):
    out = t("region").collection_join(t("nation").where("n_nationkey > 12").rename(r_regionkey="n_regionkey"), ["r_regionkey"], "x", ["n_name"])
    return out.project("r_name", nations="transform(x, e -> e.n_name)")


@rel("j19_null_safe_join", "select a.x, b.y from (select n_nationkey as x, nullif(n_regionkey, 3) as k from nation) a join (select r_name as y, nullif(r_regionkey, 3) as k from region) b on a.k is not distinct from b.k")
def _(t):
    a = t("nation").project(x="n_nationkey", k=NULLABLE).df
    b = t("region").project(y="r_name", k="nullif(r_regionkey, 3)").df
    return Rel(a.join(b, joins.null_safe(a, b, ["k"]))).project("x", "y")


@rel("j19_hash_join_core", "select o_orderkey, l_linenumber, o_orderstatus from orders join lineitem on o_orderkey = l_orderkey and nullif(o_orderstatus, 'P') = l_linestatus")
def _(t):
    built = t("orders").project("o_orderkey", "o_orderstatus", l_orderkey="o_orderkey", l_linestatus="nullif(o_orderstatus, 'P')").df.hint("shuffle_hash")  # null keys meet nothing
    return t("lineitem").join(Rel(built), ["l_orderkey", "l_linestatus"]).project("o_orderkey", "l_linenumber", "o_orderstatus")


@rel("j20_multi_way", "select n_name, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as v from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name")
def _(t):
    joined = t("lineitem").join(t("orders"), "l_orderkey = o_orderkey").join(t("customer"), "o_custkey = c_custkey").join(t("nation"), "c_nationkey = n_nationkey")
    return joined.aggregate(["n_name"], v=aggregates.exact_sum(F.col("l_extendedprice"))).project("n_name", v="cast(v as double)")


@rel("j20_salted_join", "select l_returnflag, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by l_returnflag")
def _(t):
    out = joins.salted(t("lineitem", "l_orderkey", "l_returnflag").df, t("orders", "o_orderkey").rename(l_orderkey="o_orderkey").df, ["l_orderkey"], 4)
    return Rel(out).aggregate(["l_returnflag"], n="count(*)")


# 2.4 aggregates


@rel("a1_group_by", "select l_returnflag, l_linestatus, count(*) as n, min(l_shipdate) as first, max(l_shipdate) as last from lineitem group by l_returnflag, l_linestatus")
def _(t):
    return t("lineitem").aggregate(["l_returnflag", "l_linestatus"], n="count(*)", first="min(l_shipdate)", last="max(l_shipdate)")


@rel("a2_sum", "select l_returnflag, cast(sum(l_linenumber) as bigint) as i, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as d from lineitem group by l_returnflag")
def _(t):
    return t("lineitem").aggregate(["l_returnflag"], i="sum(l_linenumber)", d="cast(sum(cast(l_extendedprice as decimal(18,2))) as double)")


@rel("a3_min", "select c_mktsegment, min(c_acctbal) as m, min(c_name) as s from customer group by c_mktsegment")
def _(t):
    return t("customer").aggregate(["c_mktsegment"], m="min(c_acctbal)", s="min(c_name)")


@rel("a4_max", "select c_mktsegment, max(c_acctbal) as m, max(c_name) as s from customer group by c_mktsegment")
def _(t):
    return t("customer").aggregate(["c_mktsegment"], m="max(c_acctbal)", s="max(c_name)")


@rel("a5_avg", "select l_returnflag, cast(trunc(cast(sum(l_linenumber) as decimal(32,6)) * 1000000 // count(*)) as double) / 1000000 as a from lineitem group by l_returnflag")
def _(t):
    return t("lineitem").aggregate(["l_returnflag"], a=aggregates.average(F.col("l_linenumber")).cast("double"))


@rel("a6_count_column", "select count(nullif(o_orderstatus, 'F')) as n, count(*) as every from orders")
def _(t):
    return t("orders").aggregate(n="count(nullif(o_orderstatus, 'F'))", every="count(*)")


@rel("a7_count_star", "select p_brand, count(*) as n from part group by p_brand")
def _(t):
    return t("part").aggregate(["p_brand"], n="count(*)")


@rel("a8_any", "select o_custkey, min(c_name) as c_name, count(*) as n from orders join customer on o_custkey = c_custkey group by o_custkey")
def _(t):
    return aggregates.dependent(t("orders").join(t("customer"), "o_custkey = c_custkey").df, "o_custkey", ["c_name"], n=F.count(F.lit(1)))


@rel("a9_distinct_aggregates", "select l_returnflag, count(distinct l_suppkey) as n, cast(sum(distinct l_linenumber) as bigint) as s from lineitem group by l_returnflag")
def _(t):
    return t("lineitem").aggregate(["l_returnflag"], n="count(distinct l_suppkey)", s="sum(distinct l_linenumber)")


@rel("a10_scalar_empty", "select count(*) as n, max(o_orderkey) as m, cast(sum(o_orderkey) as bigint) as s from orders where o_orderkey < 0")
def _(t):
    return t("orders").where("o_orderkey < 0").aggregate(n="count(*)", m="max(o_orderkey)", s="sum(o_orderkey)")


@rel("a11_group_by_expression", "select cast(extract(year from o_orderdate) as bigint) as y, o_orderkey % 3 as m, count(*) as n from orders group by 1, 2")
def _(t):
    return t("orders").aggregate({"y": "cast(extract(year from o_orderdate) as bigint)", "m": "o_orderkey % 3"}, n="count(*)")


@rel("a11_null_group", "select nullif(o_orderstatus, 'P') as s, count(*) as n from orders group by 1")
def _(t):
    return t("orders").aggregate({"s": "nullif(o_orderstatus, 'P')"}, n="count(*)")


sql("a12_having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12 and max(o_totalprice) > 200000")
sql("a13_over_aggregates", "select l_returnflag, 100 * count(*) / max(l_linenumber) as r, abs(min(l_linenumber) - max(l_linenumber)) as d from lineitem group by l_returnflag", "select l_returnflag, 100 * count(*) // max(l_linenumber) as r, abs(min(l_linenumber) - max(l_linenumber)) as d from lineitem group by l_returnflag")
sql("a14_in_aggregates", "select sum(case when l_discount > 0.05 then l_linenumber else 0 end) as s, count(l_returnflag || l_linestatus) as n, max(length(l_returnflag) + l_linenumber) as m from lineitem", "select cast(sum(case when l_discount > 0.05 then l_linenumber else 0 end) as bigint) as s, count(l_returnflag || l_linestatus) as n, max(cast(length(l_returnflag) as integer) + l_linenumber) as m from lineitem")


@rel("a15_partial_and_final", "select l_suppkey, count(*) as n, cast(sum(l_linenumber) as bigint) as s from lineitem group by l_suppkey")
def _(t):
    part = t("lineitem").aggregate(["l_suppkey", "l_returnflag"], n="count(*)", s="sum(l_linenumber)")
    return part.aggregate(["l_suppkey"], n="sum(n)", s="sum(s)")  # counts combine by sum


sql("a16_dependent_columns", "select c_custkey, c_name, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by c_custkey, c_name")


@rel("a17_many_groups", "select l_orderkey, count(*) as n from lineitem group by l_orderkey")
def _(t):
    return t("lineitem").aggregate(["l_orderkey"], n="count(*)")


@rel("a18_rollup", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup(l_returnflag, l_linestatus)")
def _(t):
    return t("lineitem").df.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@rel("a18_unknown_aggregate", "select * from (values ('count', true), ('no_such_aggregate', false)) v(name, known)")
def _(t):
    """An aggregate that does not exist is an error, and never another one in its place."""
    engine = Engine(t.spark).load(t.sf_dir, ["region"])

    def known(name: str) -> bool:
        try:
            return bool(engine.sql(f"select {name}(r_regionkey) as n from region").columns)
        except AnalysisException as e:
            if e.getCondition() != "UNRESOLVED_ROUTINE":
                raise
            return False

    return Rel.values(t.spark, "name string, known boolean", [(name, known(name)) for name in ("count", "no_such_aggregate")])


# 2.6 order, limit


@rel("o1_sort", "select n_nationkey, nullif(n_regionkey, 2) as r from nation order by r, n_nationkey desc")
def _(t):
    return t("nation").project("n_nationkey", r="nullif(n_regionkey, 2)").sort("r", ("n_nationkey", "desc"))


@rel("o2_sort_prefix", "select o_custkey, o_orderkey from orders order by o_custkey, o_orderkey")
def _(t):
    return t("orders", "o_custkey", "o_orderkey").sort("o_custkey", "o_orderkey")


@rel("o3_sort_many_keys", "select l_orderkey, l_linenumber, l_returnflag, l_extendedprice, l_shipdate from lineitem order by l_returnflag desc, l_shipdate, l_extendedprice desc, l_orderkey, l_linenumber")
def _(t):
    columns = t("lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_shipdate")
    return columns.sort(("l_returnflag", "desc"), "l_shipdate", ("l_extendedprice", "desc"), "l_orderkey", "l_linenumber")  # exchanged by ranges, spilled where memory is short


sql("o4_nulls_last_then_first", "select n_nationkey, nullif(n_regionkey, 2) as r from nation order by r desc, n_nationkey", "select n_nationkey, nullif(n_regionkey, 2) as r from nation order by r desc nulls first, n_nationkey")
sql("o4_asc_nulls_last", "select n_nationkey, nullif(n_regionkey, 0) as r from nation order by r, n_nationkey", "select n_nationkey, nullif(n_regionkey, 0) as r from nation order by r asc nulls last, n_nationkey")


@rel("o5_limit", "select c_custkey from customer order by c_custkey limit 10")
def _(t):
    return t("customer", "c_custkey").sort("c_custkey").limit(10)


@rel("o6_offset", "select c_custkey from customer order by c_custkey limit 10 offset 25")
def _(t):
    return t("customer", "c_custkey").sort("c_custkey").limit(10, offset=25)


@rel("o7_topk", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 15")
def _(t):
    return t("orders", "o_orderkey", "o_totalprice").topk(15, ("o_totalprice", "desc"), "o_orderkey")


sql("o8_sort_by_expression", "select p_partkey from part order by p_size * 2 - p_partkey % 7, upper(p_name), p_partkey")


# 2.7 set operations


def _sides(t: Tables) -> tuple[Rel, Rel]:
    return t("supplier").project(k="nullif(s_nationkey, 4)"), t("customer").project(k="nullif(c_nationkey, 4)")


SIDES = ("(select nullif(s_nationkey, 4) as k from supplier)", "(select nullif(c_nationkey, 4) as k from customer)")
for _name, _op, _f in (
    ("u1_union_all", "union all", lambda a, b: a.union(b, all=True)),
    ("u2_union", "union", lambda a, b: a.union(b)),
    ("u3_intersect", "intersect", lambda a, b: a.intersect(b)),
    ("u4_intersect_all", "intersect all", lambda a, b: a.intersect(b, all=True)),
    ("u5_except", "except", lambda a, b: a.except_(b)),
    ("u5_except_all", "except all", lambda a, b: a.except_(b, all=True)),
):
    rel(_name, f"{SIDES[0]} {_op} {SIDES[1]}")(lambda t, f=_f: f(*_sides(t)))


# 2.8 subqueries

sql("q1_scalar", "select o_orderkey from orders where o_orderdate = (select max(o_orderdate) from orders)")
sql("q2_correlated_scalar", "select o_orderkey, (select c_name from customer where c_custkey = o_custkey) as name from orders where o_totalprice > (select 1.8 * avg(b.o_totalprice) from orders b where b.o_custkey = orders.o_custkey)", "select o_orderkey, (select c_name from customer where c_custkey = o_custkey) as name from orders where o_totalprice > (select cast(1.8 as double) * avg(b.o_totalprice) from orders b where b.o_custkey = orders.o_custkey)")
sql("q3_exists", "select n_name from nation where exists (select 1 from supplier where s_nationkey = n_nationkey) and not exists (select 1 from supplier where s_nationkey = n_nationkey and s_acctbal < 0)")
sql("q4_in", "select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)")
sql("q4_not_in_with_null", "select c_custkey from customer where c_nationkey not in (select nullif(n_nationkey, 3) from nation where n_regionkey = 1)")
sql("q5_all", "select s_suppkey from supplier where s_acctbal > all (select c_acctbal from customer where c_mktsegment = 'BUILDING' and c_acctbal < 9000)")
sql("q5_all_empty", "select s_suppkey from supplier where s_acctbal > all (select c_acctbal from customer where c_custkey < 0)")
sql("q6_any", "select s_suppkey from supplier where s_acctbal < any (select c_acctbal from customer where c_mktsegment = 'BUILDING' and c_acctbal < 0)")
sql("q6_any_array", "select s_suppkey from supplier where s_nationkey = any (array[1, 5, 7])", "select s_suppkey from supplier where s_nationkey in (1, 5, 7)")
sql("q7_nested_from", "select z.k, z.n from (select y.k, count(*) as n from (select o_custkey % 10 as k from orders where o_orderstatus = 'F') y group by y.k) z where z.n > (select avg(w.c) from (select count(*) as c from orders group by o_custkey % 50) w)")
sql("q8_with", "with a as (select c_nationkey as k, count(*) as n from customer group by c_nationkey), b as (select max(n) as m from a) select a.k, a.n from a, b where a.n = b.m")
sql("q9_exists_in_scalar", "select n_nationkey, (select max(c_acctbal) from customer where c_nationkey = n_nationkey) as m from nation where (exists (select 1 from supplier where s_nationkey = n_nationkey and s_acctbal > 5000) or n_regionkey in (select r_regionkey from region where r_name = 'ASIA')) and not n_regionkey in (select r_regionkey from region where r_name = 'EUROPE')")


@rel("q9_list", "select r_name, n_nations, n_nations = 5 as full_house from (select r_regionkey, r_name, count(n_nationkey) as n_nations from region left join nation on n_regionkey = r_regionkey and n_nationkey <> 7 group by r_regionkey, r_name) x")
def _(t):
    listed = t("region").collection_join(t("nation").where("n_nationkey <> 7").rename(r_regionkey="n_regionkey"), ["r_regionkey"], "x", ["n_nationkey"])
    return listed.project("r_name", n_nations="cast(size(x) as bigint)", full_house="size(x) = 5")


# textual plans

PLAN = {
    "op": "sort",
    "keys": [["n", "desc"], "r_name"],
    "input": {
        "op": "aggregate",
        "by": ["r_name"],
        "aggregates": {"n": "count(*)"},
        "input": {"op": "join", "on": "r_regionkey = n_regionkey", "input": {"op": "scan", "table": "region"}, "right": {"op": "where", "condition": "n_nationkey > 2", "input": {"op": "scan", "table": "nation", "columns": ["n_nationkey", "n_regionkey"]}}},
    },
}


@rel("b_textual_plan", "select r_name, count(*) as n from region join nation on r_regionkey = n_regionkey where n_nationkey > 2 group by r_name")
def _(t):
    return textual.run(t.spark, json.dumps(PLAN), t.sf_dir)
