"""Small tables with the properties that the semantics turn on, and hand-derived rows."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from quillon.functions import dates, logic, numeric, text
from quillon.operators import aggregates, joins, ordering
from quillon.plans import textual
from quillon.plans.rel import Rel
from quillon.session import Engine
from quillon.sources import tables


def rows(df):
    return [tuple(r) for r in df.collect()]


def ordered(df):
    return sorted(rows(df), key=repr)


@pytest.fixture
def run(spark):
    """run(text, table=(schema, rows), ...)"""

    def f(query, **given):
        e = Engine(spark)
        for name, (schema, data) in given.items():
            e.register(name, spark.createDataFrame(data, schema))
        return rows(e.sql(query))

    return f


NULLS = ("id int, a int, b int, c int", [(1, None, 5, 9), (2, 4, None, 9), (3, None, None, 7), (4, None, None, None)])


def test_thousands_of_rows(run):
    assert run("select count(*), sum(id) from t", t=("id int", [(k,) for k in range(1, 5001)])) == [(5000, 12502500)]


def test_null_handling(run):
    assert run("select id from t where a is null order by id", t=NULLS) == [(1,), (3,), (4,)]
    assert run("select coalesce(a, b, c), coalesce(a, -1) from t order by id", t=NULLS) == [(5, -1), (4, 4), (7, -1), (None, -1)]
    assert run("select count(*), count(a), sum(a), min(b), max(c), avg(a) from t", t=NULLS) == [(4, 1, 4, 5, 9, 4.0)]
    assert run("select not (a > 1) from t order by id", t=NULLS) == [(None,), (False,), (None,), (None,)]
    assert run("select (a > 1) and (b > 1), (a > 1) or (b > 1) from t order by id", t=NULLS) == [(None, True), (None, True), (None, None), (None, None)]


def test_arithmetic(run):
    t = ("a int, b int", [(7, 2), (-7, 2), (7, -2)])
    assert run("select a + b, a - b, a * b, a / b, a % b from t", t=t) == [(9, 5, 14, 3, 1), (-5, -9, -14, -3, -1), (5, 9, -14, -3, 1)]


def test_text(run):
    t = ("s string", [("Apple",), ("apricot",), ("banana",), (None,)])
    assert run("select upper(s), substring(s, 2, 3), s || '!' from t where s like '_pr%'", t=t) == [("APRICOT", "pri", "apricot!")]
    assert run("select s from t where s not like 'a%' order by s", t=t) == [("Apple",), ("banana",)]


def test_special_operators(run):
    t = ("v int, g int", [(5, 1), (15, 2), (25, 3), (None, 1)])
    assert run("select v from t where v between 5 and 15 order by v", t=t) == [(5,), (15,)]
    assert run("select v from t where g in (1, 3) order by v", t=t) == [(5,), (25,), (None,)]
    assert run("select case when v < 10 then 'low' when v < 20 then 'mid' end from t order by v", t=t) == [("low",), ("mid",), (None,), (None,)]


def test_order(run):
    t = ("d string, s int, n string", [("b", 1, "x"), ("a", 2, "y"), ("a", 2, "x"), (None, 3, "z"), ("a", None, "w")])
    assert run("select d, s, n from t order by d, s desc, n", t=t) == [("a", None, "w"), ("a", 2, "x"), ("a", 2, "y"), ("b", 1, "x"), (None, 3, "z")]
    assert run("select n from t order by s * -1, n desc limit 2 offset 1", t=t) == [("y",), ("x",)]


def test_group_by_having(run):
    t = ("d string, a decimal(10,2)", [("x", D("10.00")), ("x", D("20.50")), ("y", D("5.25")), (None, D("1.00")), (None, D("2.00"))])
    assert run("select d, sum(a), count(*) from t group by d having count(*) > 1 order by d", t=t) == [("x", D("30.50"), 2), (None, D("3.00"), 2)]
    assert run("select d from t group by d having sum(a) > 5 and max(a) < 10", t=t) == [("y",)]


def test_distinct(run):
    t = ("c int, v int", [(1, 10), (1, 10), (2, 10), (2, 20), (None, 20), (None, 20)])
    assert sorted(run("select distinct c, v from t", t=t), key=repr) == sorted([(1, 10), (2, 10), (2, 20), (None, 20)], key=repr)
    assert run("select sum(v), sum(distinct v), count(distinct c) from t", t=t) == [(90, 30, 2)]


def test_types(run, spark):
    t = (
        "b boolean, i smallint, f float, d decimal(10,2), x date, ts timestamp_ntz",
        [(True, 3, 1.5, D("-2.50"), dt.date(2024, 2, 29), dt.datetime(2024, 1, 15, 10, 30, 0, 123456)), (None,) * 6, (False, 0, 0.0, D("0.00"), dt.date(1999, 12, 31), dt.datetime(2000, 1, 1))],
    )
    assert run("select b = true, i > 0, f * 2.0, d + 1, x = '2024-02-29', ts > '2024-01-01 00:00:00' from t where b is not null order by i desc", t=t) == [(True, True, 3.0, D("-1.50"), True, True), (False, False, 0.0, D("1.00"), False, False)]
    assert run("select min(x), max(ts), count(d), sum(i) from t", t=t) == [(dt.date(1999, 12, 31), dt.datetime(2024, 1, 15, 10, 30, 0, 123456), 2, 3)]
    assert dict(Engine(spark).table("t").dtypes)["ts"] == "timestamp_ntz"


def test_decimals_truncate(spark):
    df = spark.createDataFrame([(D("2.50"), D("3.000")), (D("-2.50"), D("3.000")), (D("1.00"), D("0.000"))], "q decimal(10,2), n decimal(8,3)")
    assert rows(df.select(numeric.div_trunc(F.col("q"), F.col("n")))) == [(D("0.833333"),), (D("-0.833333"),), (None,)]
    assert rows(df.select(numeric.mul_trunc(F.col("q"), F.lit(D("0.3333333")))))[0] == (D("0.833333"),)
    assert rows(df.agg(aggregates.average(F.col("q"))))[0] == (D("0.333333"),)
    assert numeric.add_type(12, 2, 10, 4) == (14, 4) and numeric.mul_type(20, 4, 20, 4) == (32, 6) and numeric.div_type(10, 2, 12, 5) == (12, 5)


def test_average_cuts_off(spark):
    df = spark.createDataFrame([(D("4654.9382970"),), (D("4654.9382980"),)], "v decimal(20,7)")
    assert rows(df.agg(aggregates.average(F.col("v").cast("decimal(20,6)"), 6)))[0][0] == D("4654.938297")


LEFT = ("id int, v string", [(1, "a"), (2, "b"), (None, "n"), (4, "d")])
RIGHT = ("id int, w string", [(1, "x"), (1, "y"), (None, "m"), (5, "z")])


@pytest.fixture
def sides(spark):
    return Rel(spark.createDataFrame(LEFT[1], LEFT[0])), Rel(spark.createDataFrame(RIGHT[1], RIGHT[0]))


@pytest.mark.parametrize(
    "kind, want",
    [
        ("inner", [(1, "a", "x"), (1, "a", "y")]),
        ("left", [(1, "a", "x"), (1, "a", "y"), (2, "b", None), (None, "n", None), (4, "d", None)]),
        ("right", [(1, "a", "x"), (1, "a", "y"), (None, None, "m"), (5, None, "z")]),
        ("full", [(1, "a", "x"), (1, "a", "y"), (2, "b", None), (None, "n", None), (4, "d", None), (None, None, "m"), (5, None, "z")]),
        ("semi", [(1, "a")]),
        ("anti", [(2, "b"), (None, "n"), (4, "d")]),
        ("right_semi", [(1, "x"), (1, "y")]),
        ("right_anti", [(None, "m"), (5, "z")]),
    ],
)
def test_joins(sides, kind, want):
    assert ordered(sides[0].join(sides[1], ["id"], kind).df) == sorted(want, key=repr)


def test_other_joins(sides, spark):
    left, right = sides
    assert ordered(left.mark_join(right, "m", ["id"]).project("v", "m").df) == [("a", True), ("b", False), ("d", False), ("n", False)]
    on = left.df["id"] <= right.df["id"]
    assert ordered(left.mark_join(right, "m", on).project("v", "m").df) == [("a", True), ("b", True), ("d", True), ("n", False)]
    got = left.collection_join(right, ["id"], "ws", ["w"]).project("v", ws="transform(ws, x -> x.w)")
    assert ordered(got.df) == [("a", ["x", "y"]), ("b", []), ("d", []), ("n", [])]
    one = Rel(spark.createDataFrame([(1, "x"), (4, "y")], "id int, w string"))
    assert ordered(left.single_join(one, ["id"]).project("v", "w").df) == [("a", "x"), ("b", None), ("d", "y"), ("n", None)]
    with pytest.raises(Exception, match="more than one row"):
        left.single_join(right, ["id"]).df.collect()
    assert left.cross(right.rename(k="id")).df.count() == 16
    a, b = left.df, right.df
    assert a.join(b, joins.null_safe(a, b, ["id"])).count() == 3
    assert ordered(joins.salted(a, b, ["id"], 3, "left").select("v", "w")) == ordered(a.join(b, "id", "left").select("v", "w"))


def test_set_operations(spark):
    a = Rel.values(spark, "k int", [(1,), (1,), (2,), (None,), (None,)])
    b = Rel.values(spark, "k int", [(1,), (None,), (None,), (3,)])
    got = lambda r: ordered(r.df)
    assert len(got(a.union(b, all=True))) == 9
    assert got(a.union(b)) == [(1,), (2,), (3,), (None,)]
    assert got(a.intersect(b)) == [(1,), (None,)]
    assert got(a.intersect(b, all=True)) == [(1,), (None,), (None,)]
    assert got(a.except_(b)) == [(2,)]
    assert got(a.except_(b, all=True)) == [(1,), (2,)]


STAFF = ("id int, name string, dept int, pay int", [(1, "Ann", 10, 100), (2, "Bob", 10, 80), (3, "Cid", 20, 90), (4, "Dee", None, 70)])
DEPTS = ("dept int, title string", [(10, "ops"), (20, "lab"), (30, "law")])


def test_nested_queries(run):
    given = {"staff": STAFF, "depts": DEPTS}
    assert run("select name from staff s where pay > (select avg(pay) from staff x where x.dept = s.dept) order by 1", **given) == [("Ann",)]
    assert run("select title from depts d where not exists (select 1 from staff s where s.dept = d.dept)", **given) == [("law",)]
    assert run("select name from staff where dept not in (select dept from depts where title = 'lab') order by 1", **given) == [("Ann",), ("Bob",)]
    assert run("select title from depts where dept not in (select dept from staff)", **given) == []  # a null decides nothing
    assert run("select title, (select max(pay) from staff s where s.dept = d.dept) m from depts d order by dept", **given) == [("ops", 100), ("lab", 90), ("law", None)]
    assert run("with t as (select dept, sum(pay) p from staff group by dept) select title, p from depts join t on depts.dept = t.dept order by p", **given) == [("lab", 90), ("ops", 180)]
    assert run("select dept, count(*) from staff group by dept having sum(pay) > (select avg(pay) from staff) order by dept", **given) == [(10, 2), (20, 1)]


def test_blank_padded(spark):
    df = spark.createDataFrame([("ab   ",), ("abc  ",), (None,)], "ch string")
    assert rows(df.where(text.padded_equal(F.col("ch"), "ab"))) == [("ab   ",)]
    assert df.where(text.padded_in(F.col("ch"), ["ab ", "abc"])).count() == 2
    assert rows(df.select(text.char(F.rtrim("ch"), 6)))[0] == ("ab    ",)


def test_functions(spark):
    df = spark.createDataFrame([("a%b", dt.date(2024, 1, 31), 5), (None, None, None)], "s string, d date, n int")
    got = df.select(
        text.like(F.col("s"), "a\\%_").alias("l"), text.not_like(F.col("s"), "a%"), text.substring(F.col("s"), -3, 2), text.substring(F.col("s"), 2), text.concat(F.col("s"), F.lit("x")),
        dates.add(F.col("d"), months=1), dates.subtract(F.col("d"), days=31), dates.part("month", F.col("d")), logic.is_true(F.col("n") > 1), logic.one_of(F.col("n"), []), logic.none_of(F.col("n"), [5, None]),
        logic.case_of(F.col("n"), (F.lit(5), F.lit("five")), otherwise=F.lit("else")), numeric.int_div(F.col("n") * -1, F.lit(2)), numeric.modulo(F.col("n") * -1, F.lit(3)),
    )
    assert rows(got) == [
        (True, False, "a%", "%b", "a%bx", dt.date(2024, 2, 29), dt.date(2023, 12, 31), 1, True, False, False, "five", -2, -2),
        (None, None, None, None, None, None, None, None, False, False, None, "else", None, None),
    ]
    with pytest.raises(ValueError):
        dates.part("hour", F.col("d"))


def test_builder_and_limits(spark):
    r = Rel.values(spark, "k int, v string", [(3, "c"), (1, None), (2, "b")])
    assert rows(r.sort(("v", "desc"), "k").df) == [(1, None), (3, "c"), (2, "b")]
    assert rows(r.topk(1, ("k", "desc")).df) == [(3, "c")]
    assert rows(r.aggregate(n="count(*)", s="sum(k)").df) == [(3, 6)]
    assert rows(r.aggregate({"odd": "k % 2"}, "n > 1", n="count(*)").df) == [(1, 2)]
    assert rows(r.where("k = 2").rename(key="k").materialize("v", "key", names=["x", "y"])) == [("b", 2)]
    assert rows(Rel.result(spark, a="1 + 1").df) == [(2,)]
    for bad in ((-1, 0), (1, -1)):
        with pytest.raises(ValueError):
            r.limit(*bad)
    assert len(ordering.keys(["a", ("b", "desc"), ("c", "asc", "first")])) == 3


def test_textual_plan(spark):
    Rel.values(spark, "id int, value int", [(1, 100), (2, 200), (3, 300)]).df.createOrReplaceTempView("numbers")
    assert ordered(textual.run(spark, '{"op": "scan", "table": "numbers"}')) == [(1, 100), (2, 200), (3, 300)]
    plan = '{"op": "limit", "n": 1, "input": {"op": "sort", "keys": [["value", "desc"]], "input": {"op": "where", "condition": "id < 3", "input": {"op": "scan", "table": "numbers"}}}}'
    assert rows(textual.run(spark, plan)) == [(2, 200)]
    with pytest.raises(ValueError):
        textual.run(spark, '{"op": "nothing"}')


def test_sources_and_sinks(spark, tmp_path):
    df = tables.values(spark, "a int, b string, d date", [(1, "x|y", dt.date(2024, 1, 1)), (2, None, None)])
    for kind in ("parquet", "orc", "json"):
        tables.write(df, f"{tmp_path}/{kind}", kind)
        assert ordered(spark.read.schema(df.schema).format(kind).load(f"{tmp_path}/{kind}")) == ordered(df)
    tables.write(df, f"{tmp_path}/parts", partition_by=["a"])
    assert "PartitionFilters: [isnotnull(a" in spark.read.parquet(f"{tmp_path}/parts").where("a = 1")._jdf.queryExecution().toString()
    (tmp_path / "t.tbl").write_text("1|one|2024-01-02|\n2|\\N|2024-01-03|\n")
    assert rows(tables.scan_delimited(spark, f"{tmp_path}/t.tbl", "a int, b string, d date")) == [(1, "one", dt.date(2024, 1, 2)), (2, None, dt.date(2024, 1, 3))]


def test_decode_at_scan(run):
    data = [(k, D(k % 7), D(k) * 2, dt.date(2024, 1, 1) + dt.timedelta(k % 30), "open" if k % 3 else "shut", f"n{k}") for k in range(1, 201)]
    got = run("select status, count(*), sum(quantity * price), min(ship_date) from t where ship_date < date '2024-01-11' and note like 'n1%' group by status order by status", t=("id int, quantity decimal(10,2), price decimal(12,2), ship_date date, status string, note string", data))
    want = {}
    for k, q, p, d, s, n in data:
        if d < dt.date(2024, 1, 11) and n.startswith("n1"):
            c, t, m = want.get(s, (0, D(0), d))
            want[s] = c + 1, t + q * p, min(m, d)
    assert got == [(s, *want[s]) for s in sorted(want)]


def test_dependent_columns(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (2, "b", 7)], "k int, n string, v int")
    assert ordered(aggregates.dependent(df, "k", ["n"], s=F.sum("v"))) == [(1, "a", 11), (2, "b", 7)]
    assert ordered(aggregates.grouped_distinct(df, ["k"], "n", c=F.count)) == [(1, 1), (2, 1)]
