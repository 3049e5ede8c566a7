"""Sorts over every type, joins with aggregates, and the hard forms of TPC-H on tables small enough to check by eye."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from quillon import registry
from quillon.plans.rel import Rel
from quillon.session import Engine
from quillon.suite import tpch


@pytest.fixture
def run(spark):
    def f(query, **given):
        e = Engine(spark)
        for name, (schema, data) in given.items():
            e.register(name, spark.createDataFrame(data, schema))
        return [tuple(r) for r in e.sql(query).collect()]

    return f


SORTED = (
    "id int, s string, d date, ts timestamp_ntz, v decimal(10,2), f double, b boolean",
    [
        (1, "banana", dt.date(2024, 3, 1), dt.datetime(2024, 1, 1, 12), D("10.50"), 1.5, True),
        (2, "Apple", dt.date(2023, 12, 31), dt.datetime(2024, 1, 1, 11, 59, 59, 999999), D("10.50"), -0.5, False),
        (3, None, None, None, None, None, None),
        (4, "apple", dt.date(2024, 2, 29), dt.datetime(2023, 6, 1), D("-3.25"), 1.5, True),
    ],
)


@pytest.mark.parametrize(
    "order, want",
    [
        ("s", [2, 4, 1, 3]),
        ("s desc", [3, 1, 4, 2]),
        ("d", [2, 4, 1, 3]),
        ("ts desc", [3, 1, 2, 4]),
        ("v, id", [4, 1, 2, 3]),
        ("v desc, id desc", [3, 2, 1, 4]),
        ("f desc nulls last, id", [1, 4, 2, 3]),
        ("b, id desc", [2, 4, 1, 3]),
        ("upper(s), id", [2, 4, 1, 3]),
        ("coalesce(v, 0) desc, id", [1, 2, 3, 4]),
    ],
)
def test_sorts(run, order, want):
    assert [r[0] for r in run(f"select id from t order by {order}", t=SORTED)] == want


def test_sort_after_join_and_group(run):
    given = {
        "regions": ("region_id int, region string", [(1, "north"), (2, "south"), (3, "empty")]),
        "towns": ("town string, region_id int, people int", [("a", 1, 5), ("b", 1, 7), ("c", 2, 20), ("d", None, 1)]),
    }
    assert run("select region, count(town), sum(people) from regions r left join towns t on r.region_id = t.region_id group by region order by 3 desc, 1", **given) == [("empty", 0, None), ("south", 1, 20), ("north", 2, 12)]
    assert run("select region, people from regions r join towns t on r.region_id = t.region_id order by region, people desc limit 2", **given) == [("north", 7), ("north", 5)]
    assert run("select region from regions where region_id in (select region_id from towns where people > 6) order by region desc", **given) == [("south",), ("north",)]


ITEMS = (
    "o int, s int, price decimal(12,2), discount decimal(12,2), qty decimal(12,2), mode string, shipped date",
    [
        (1, 10, D("100.00"), D("0.10"), D("5"), "AIR", dt.date(1996, 1, 5)),
        (1, 11, D("50.00"), D("0.00"), D("30"), "RAIL", dt.date(1996, 2, 5)),
        (2, 10, D("80.00"), D("0.05"), D("12"), "AIR", dt.date(1996, 7, 1)),
        (3, 12, D("10.00"), D("0.06"), D("1"), "SHIP", dt.date(1995, 12, 31)),
    ],
)
ORDERS = ("o int, c int, placed date, status string", [(1, 7, dt.date(1996, 1, 1), "F"), (2, 7, dt.date(1996, 6, 30), "O"), (3, 8, dt.date(1995, 1, 1), "F"), (4, 9, dt.date(1995, 5, 5), "P")])
GIVEN = {"items": ITEMS, "orders": ORDERS}


def test_decimal_aggregates(run):
    assert run("select sum(price * (1 - discount)) from items where discount between 0.04 and 0.06 and qty < 24", **GIVEN) == [(D("85.4000"),)]
    assert run("select cast(100.00 * sum(case when mode like 'A%' then price else 0 end) / sum(price) as decimal(10,2)) from items", **GIVEN) == [(D("75.00"),)]


def test_exists_and_not_exists_in_one_query(run):
    q = """select i.s, count(*) from items i, orders r where i.o = r.o and r.status = 'F'
           and exists (select 1 from items x where x.o = i.o and x.s <> i.s) and not exists (select 1 from items x where x.o = i.o and x.s <> i.s and x.qty > i.qty) group by i.s order by i.s"""
    assert run(q, **GIVEN) == [(11, 1)]


def test_correlated_average_and_having_subquery(run):
    assert run("select o, s from items i where qty < (select 0.9 * avg(qty) from items x where x.s = i.s) order by o, s", **GIVEN) == [(1, 10)]
    assert run("select s from items group by s having sum(price) > (select 0.5 * sum(price) from items) order by s", **GIVEN) == [(10,)]


def test_outer_join_counts(run):
    assert run("select n, count(*) from (select r.o, count(i.s) as n from orders r left outer join items i on r.o = i.o and i.mode not like '%I%' group by r.o) q group by n order by n desc", **GIVEN) == [(0, 4)]
    assert run("select n, count(*) from (select r.o, count(i.s) as n from orders r left outer join items i on r.o = i.o group by r.o) q group by n order by n desc", **GIVEN) == [(2, 1), (1, 2), (0, 1)]


def test_with_used_twice_and_or_of_ands(run):
    q = "with rev as (select s, sum(price) as t from items where shipped >= date '1996-01-01' and shipped < date '1996-01-01' + interval '3' month group by s) select s, t from rev where t = (select max(t) from rev)"
    assert run(q, **GIVEN) == [(10, D("100.00"))]
    assert run("select sum(i.price) from items i, orders r where (r.o = i.o and r.c = 7 and i.mode in ('AIR', 'RAIL') and i.qty between 10 and 40) or (r.o = i.o and r.c = 8 and i.qty <= 1)", **GIVEN) == [(D("140.00"),)]


def test_years_and_intervals(run):
    assert run("select extract(year from placed) as y, count(*) from orders group by extract(year from placed) order by y desc", **GIVEN) == [(1996, 2), (1995, 2)]
    assert run("select o from orders where placed + interval '1 year' > date '1996-12-31' order by o", **GIVEN) == [(1,), (2,)]


def test_temporaries_are_written_once_and_read_again(spark):
    drawn = Rel(spark.range(100).withColumn("r", F.rand())).tmp()
    assert drawn.df.collect() == drawn.df.collect() and drawn.df.count() == 100
    assert "rand(" not in drawn.df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    empty = Rel(spark.range(0).withColumn("s", F.lit("x"))).tmp()
    assert empty.df.columns == ["id", "s"] and empty.df.collect() == []


def test_partsupp_is_written_once_and_joined_without_an_exchange(spark):
    engine = tpch.engine(spark, "/root/testdata/sf0.001", "t_partsupp")
    before = [t.name for t in spark.catalog.listTables() if not t.isTemporary]
    tpch.engine(spark, "/root/testdata/sf0.001", "t_partsupp")
    assert [t.name for t in spark.catalog.listTables() if not t.isTemporary] == before
    pairs = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().count()
    assert engine.table("t_partsupp").count() == pairs
    assert "Exchange" not in engine.explain("select ps_partkey, count(*) as n from t_partsupp group by ps_partkey")


def test_order_by_many_keys(spark):
    got = registry.queries()["o3_sort_many_keys"](spark, "/root/testdata/sf0.001").collect()
    want = sorted(got, key=lambda r: (-ord(r.l_returnflag), r.l_shipdate, -r.l_extendedprice, r.l_orderkey, r.l_linenumber))
    assert got == want and len(got) > 5000
