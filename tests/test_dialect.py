"""PostgreSQL's dialect in Spark SQL."""

import pytest

from quillon.plans import dialect
from quillon.session import Engine


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    rows = [(1, "pen", 10, 5), (2, "ink", 10, 9), (3, "cup", 20, 7), (4, "jar", 20, None), (5, "map", 30, 12)]
    return e.register("goods", spark.createDataFrame(rows, "id int, name string, kind int, price int"))


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "text, want",
    [
        ("select a::int8", "select a::bigint"),
        ("select a::numeric", "select a::decimal (32, 6)"),
        ("select cast(a as double precision)", "select cast (a as double)"),
        ("select cast(a as character varying(9)), b::varchar(3)", "select cast (a as string), b::string"),
        ("select a ~~ 'x%', a !~~ 'y'", "select a LIKE 'x%', a NOT LIKE 'y'"),
        ("select 'it''s', 'a\\b'", "select 'it\\'s', 'a\\\\b'"),
        ('select "A b" from t', "select `A b` from t"),
        ("select x from t order by a desc, b asc, c nulls first", "select x from t order by a desc NULLS FIRST, b asc NULLS LAST, c nulls first"),
        ("select 1 -- x\n/* y */ + 2", "select 1 + 2"),
    ],
)
def test_text(text, want):
    assert dialect.translate(text) == want


def test_integer_division_needs_integers():
    assert "DIV" in dialect.translate("select a / b", {"a", "b"})
    assert "DIV" in dialect.translate("select (a + 1) / 2 * b", {"a", "b"})
    assert "DIV" in dialect.translate("select count(*) / 2")
    assert "DIV" not in dialect.translate("select a / b", {"a"})
    assert "DIV" not in dialect.translate("select a / 2.0", {"a"})
    assert "DIV" not in dialect.translate("select x * a / 2", {"a"})


def test_quantified(engine):
    assert rows(engine.sql("select name from goods where price > all (select price from goods where kind = 10) order by name")) == [("map",)]
    # a null among the values leaves the comparison unknown
    assert rows(engine.sql("select name from goods where price > all (select price from goods where kind = 20)")) == []
    assert len(rows(engine.sql("select name from goods where price > all (select price from goods where kind = 99)"))) == 5
    assert rows(engine.sql("select name from goods where price < any (select price from goods where kind = 20) order by 1")) == [("pen",)]
    assert rows(engine.sql("select name from goods where id = any (array[2, 3]) order by id")) == [("ink",), ("cup",)]
    assert rows(engine.sql("select name from goods where kind = any (select kind from goods where price = 12)")) == [("map",)]


@pytest.mark.parametrize("word", ["all", "any"])
def test_extremes_decide_as_rows_do(engine, spark, word):
    for inner in ("kind = 10", "kind = 20", "price is null", "id < 0", "id = 2"):
        for op in ("<", "<=", ">", ">=", "=", "<>"):
            text = f"select id, price {op} {word} (select price from goods where {inner}) as c from goods order by id"
            assert rows(spark.sql(dialect.translate(text, alone=lambda q: True))) == rows(spark.sql(dialect.translate(text))), text


def test_quantified_plans(engine):
    plan = lambda text: engine.sql(text)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan("select id from goods where price > all (select price from goods where kind = 10)")
    assert rows(engine.sql("select id from goods g where price >= all (select h.price from goods h where h.kind = g.kind and h.price is not null) order by id")) == [(2,), (3,), (5,)]
    assert rows(engine.sql("with w as (select 8 as v) select id from goods where price < any (select v from w) order by id")) == [(1,), (3,)]
    assert rows(engine.sql("select id from goods where price < any (select price from goods where id = $1) order by id", [2])) == [(1,), (3,)]


def test_null_order(engine):
    assert [r[0] for r in rows(engine.sql("select price from goods order by price"))] == [5, 7, 9, 12, None]
    assert [r[0] for r in rows(engine.sql("select price from goods order by price desc limit 2"))] == [None, 12]


def test_division_and_parameters(engine):
    assert rows(engine.sql("select id, (price - 8) / 2 as h from goods where id < 3 order by id")) == [(1, -1), (2, 0)]
    engine.sql("PREPARE p (int, int) AS SELECT id FROM goods WHERE price > $1 AND kind < $2")
    assert rows(engine.sql("EXECUTE p(4, 20)")) == [(1,), (2,)]
    engine.sql("DEALLOCATE p")
    with pytest.raises(KeyError):
        engine.sql("EXECUTE p(1, 2)")
    assert rows(engine.sql("select id from goods where price > $1 and kind = $2", [6, 20])) == [(3,)]
    assert rows(engine.sql("select id from goods where price > :p", {"p": 10})) == [(5,)]


def test_scalar_subquery_with_two_rows_fails(engine):
    with pytest.raises(Exception, match="(?i)more than one row"):
        engine.sql("select (select price from goods where kind = 10) from goods").collect()


def test_explain_shows_pushdown(spark):
    from quillon.sources import tables

    e = Engine(spark, "/root/testdata/sf0.001")
    plan = e.explain("select l_orderkey from lineitem where l_quantity < 3")
    assert "PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity,3.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    assert tables.SCHEMAS["lineitem"].count(",") == 10


@pytest.mark.parametrize(
    "query, want",
    [
        ("select x.k / 2 as v from (select id as k from goods where id = 3) x", 1),
        ("with a as (select count(*) as n from (values (1), (2), (3)) t(q)) select n / 2 as v from a", 1),
        ("select cast(7 as int) / 2 as v", 3),
        ("select extract(year from date '1998-05-01') / 100 as v", 19),
        ("select (x.k + 4) / 2 / 2 as v from (select max(id) as k from goods where id = 3) x", 1),
        ("select -7 / cast(2 as bigint) as v", -3),
        ("select cast(7 as int) / 2.0 as v", 3.5),
        ("select cast(7 as double) / cast(2 as double) as v", 3.5),
        ("select (select y.k / 2 from (select 5 as k) y) as v", 2),
        ("select count(*) as v from goods g where g.id / 2 = 1 and exists (select 1 from goods h where h.id / 2 = 1)", 2),
    ],
)
def test_division_by_the_types_of_the_operands(engine, query, want):
    assert float(rows(engine.sql(query))[0][0]) == want


def test_parameters_in_any_order_and_more_than_once(engine):
    assert rows(engine.sql("select id from goods where kind = $2 and price > $1 and price > $1", [6, 20])) == rows(engine.sql("select id from goods where price > $1 and kind = $2", [6, 20]))
