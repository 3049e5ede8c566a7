"""Scalar expressions and functions, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import dates, logic, numeric, text
from quillon.suite.relational import rel, sql

c = F.col

# 2.9 operators


@rel("e1_arithmetic", "select l_orderkey + l_linenumber as a, l_orderkey - l_partkey as s, l_linenumber * 3 as m, l_quantity * l_tax as f, cast(l_quantity as decimal(12,2)) + cast(l_tax as decimal(6,4)) as d from lineitem")
def _(t):
    return t("lineitem").project(a="l_orderkey + l_linenumber", s="l_orderkey - l_partkey", m="l_linenumber * 3", f="l_quantity * l_tax", d="cast(cast(l_quantity as decimal(12,2)) + cast(l_tax as decimal(6,4)) as decimal(15,4))")


@rel("e2_integer_division", "select p_partkey, cast((p_size - 25) // 4 as integer) as q from part")
def _(t):
    return t("part").project("p_partkey", q=numeric.int_div(c("p_size") - 25, F.lit(4)))


sql("e2_integer_division_sql", "select p_partkey, (p_size - 25) / 4 as q, p_partkey / p_size as r, p_retailprice / 2 as f from part", "select p_partkey, cast((p_size - 25) // 4 as bigint) as q, p_partkey // p_size as r, p_retailprice / 2 as f from part")

sql("e2_integer_division_alias", "select x.k / 2 as q from (select n_nationkey as k from nation) x", "select cast(x.k // 2 as bigint) as q from (select n_nationkey as k from nation) x")
sql("e2_integer_division_cte", "with a as (select o_custkey as k, count(*) as n from orders group by o_custkey) select k, n / 2 as q, n / 2 / 3 as r from a", "with a as (select o_custkey as k, count(*) as n from orders group by o_custkey) select k, n // 2 as q, n // 2 // 3 as r from a")
sql("e2_integer_division_cast", "select cast(p_retailprice as int) / 7 as q, p_size::float8 / 4 as f from part", "select cast(cast(trunc(p_retailprice) as integer) // 7 as bigint) as q, p_size / cast(4 as double) as f from part")
sql("e2_integer_division_extract", "select o_orderkey, extract(year from o_orderdate) / 100 as c from orders", "select o_orderkey, extract(year from o_orderdate) // 100 as c from orders")


@rel("e3_float_division", "select l_orderkey, l_linenumber, l_extendedprice / l_quantity as u from lineitem")
def _(t):
    return t("lineitem").project("l_orderkey", "l_linenumber", u="l_extendedprice / l_quantity")


@rel("e4_decimal_division", "select p_partkey, cast((p_partkey * 1000000) // 7 as double) / 1000000 as q from part")
def _(t):
    return t("part").project("p_partkey", q=numeric.div_trunc(c("p_partkey").cast("decimal(18,2)"), F.lit(7)).cast("double"))


@rel("e5_modulo", "select p_partkey, (p_size - 25) % 7 as m from part")
def _(t):
    return t("part").project("p_partkey", m=numeric.modulo(c("p_size") - 25, F.lit(7)))


@rel("e6_date_interval", "select o_orderkey, cast(cast(o_orderdate as date) + interval 90 day as date) as later, cast(cast(o_orderdate as date) - interval 3 month as date) as earlier, cast(cast(o_orderdate as date) + interval 1 year as date) as next from orders")
def _(t):
    d = c("o_orderdate").cast("date")
    return t("orders").project("o_orderkey", later=dates.add(d, days=90), earlier=dates.subtract(d, months=3), next=dates.add(d, years=1))


sql("e6_date_interval_sql", "select o_orderkey from orders where o_orderdate >= date '1997-01-31' + interval '1' month and o_orderdate < date '1998-12-01' - interval '90' day")
sql("e7_comparisons", "select p_partkey, p_size = 7 as eq, p_size <> 7 as ne, p_size != 8 as nn, p_size < 7 as lt, p_size <= 7 as le, p_retailprice > 1000 as gt, p_retailprice >= 1000.5 as ge, nullif(p_size, 7) > 3 as n from part")
sql("e8_string_compare", "select n_name from nation where n_name > 'NATION_2' and n_name <= 'NATION_23'")


@rel("e9_padded_compare", "select n_nationkey from nation where n_name in ('NATION_7', 'NATION_9') or n_name = 'NATION_11'")
def _(t):
    padded = t("nation").map(ch=text.char(c("n_name"), 25))
    return padded.where(text.padded_in(c("ch"), ["NATION_7 ", "NATION_9"]) | text.padded_equal(c("ch"), "NATION_11   ")).project("n_nationkey")


sql("e10_like", "select p_partkey, p_name from part where p_name like '%re%' and p_name not like 'g%' and p_brand like 'Brand#_'")
sql("e10_operator_spelling", "select n_name from nation where n_name ~~ 'NATION\\__' and n_name !~~ '%3'", "select n_name from nation where n_name like 'NATION\\__' escape '\\' and n_name not like '%3'")
sql("e11_concat", "select n_name || '-' || nullif(n_name, 'NATION_3') as s from nation")
sql("e12_logic", "select n_nationkey, (nullif(n_regionkey, 1) > 1) and n_nationkey > 5 as a, (nullif(n_regionkey, 1) > 1) or n_nationkey > 5 as o, not (nullif(n_regionkey, 1) > 1) as n from nation")
sql("e13_is_null", "select n_nationkey, nullif(n_regionkey, 1) is null as a, nullif(n_regionkey, 1) is not null as b from nation")
sql("e14_coalesce", "select n_nationkey, coalesce(nullif(n_regionkey, 1), nullif(n_nationkey, 8), -1) as v from nation")


@rel("e15_in_list", "select c_custkey from customer where c_nationkey in (1, 2, 3) and c_mktsegment not in ('BUILDING', 'MACHINERY')")
def _(t):
    return t("customer").where(logic.one_of(c("c_nationkey"), [1, 2, 3, None]) & logic.none_of(c("c_mktsegment"), ["BUILDING", "MACHINERY"])).project("c_custkey")


sql("e15_not_equal_all", "select c_custkey from customer where c_nationkey <> all (array[1, 2, 3])", "select c_custkey from customer where c_nationkey not in (1, 2, 3)")
sql("e16_between", "select p_partkey from part where p_size between 5 and 9 and p_retailprice not between 1000 and 1500")
sql("e17_case_searched", "select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'mid' end as s from part")
sql("e18_case_simple", "select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 2 else 0 end as s from orders")


@rel("e18_case_builder", "select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 2 end as s from orders")
def _(t):
    return t("orders").project("o_orderkey", s=logic.case_of(c("o_orderstatus"), ("F", F.lit(1)), ("O", F.lit(2))))


@rel("e19_literals", "select true as b, cast(1 as smallint) as i2, 2 as i4, cast(3 as bigint) as i8, cast(1.5 as float) as f4, cast(2.5 as double) as f8, cast(1.25 as decimal(5,2)) as d, date '2024-02-29' as dt, timestamp '2024-02-29 01:02:03' as ts, 'x' as s, cast(null as integer) as n from region")
def _(t):
    return t("region").project(b="true", i2="2S - 1S", i4="2", i8="3L", f4="1.5F", f8="2.5D", d="cast(1.25 as decimal(5,2))", dt="date '2024-02-29'", ts="timestamp_ntz '2024-02-29 01:02:03'", s="'x'", n="cast(null as int)")


sql("e20_column_references", "select n.n_nationkey as k, n.n_name::varchar(30)::text as s, r.* from nation as n, region as r where n.n_regionkey = r.r_regionkey and n.n_name::varchar(30) <> 'NATION_3'", "select n.n_nationkey as k, n.n_name as s, r.* from nation as n, region as r where n.n_regionkey = r.r_regionkey and n.n_name <> 'NATION_3'")
sql("e21_unary_minus", "select -p_size as m, -p_retailprice as d, +p_partkey as p from part")


@rel("e22_parameters", "select o_orderkey from orders where o_totalprice > 300000 and o_custkey < 700")
def _(t):
    from quillon.session import Engine

    e = Engine(t.spark, t.sf_dir)
    e.sql("prepare big (int, int) as select o_orderkey from orders where o_totalprice > $1 and o_custkey < $2")
    return e.sql("execute big(300000, 700)")


@rel("e22_parameters_reused", "select o_orderkey, o_custkey + 5 as k from orders where o_totalprice > 200000 and o_custkey > 5")
def _(t):
    from quillon.session import Engine

    return Engine(t.spark, t.sf_dir).sql("select o_orderkey, o_custkey + $2 as k from orders where o_totalprice > $1 and o_custkey > $2", [200000, 5])


# 2.10 functions and casts

sql("f1_abs", "select abs(p_size - 25) as i, abs(p_retailprice - 1200) as d, abs(cast(p_size - 25 as decimal(6,2))) as n from part")
sql("f2_abs_numeric", "select c_custkey, abs(cast(c_acctbal as decimal(12,2)) - 4000.5) as a from customer where abs(cast(c_acctbal as decimal(12,2))) < 5000.25")
sql("f3_upper_lower", "select upper(p_name) as u, lower(p_brand) as l from part")
sql("f4_substring", "select substring(p_name, 2, 3) as a, substring(p_name from 3 for 2) as b, substr(p_name, 4) as d from part")


@rel("f4_substring_clamped", "select p_partkey, substring(p_name, 1, 3) as s from part")
def _(t):
    return t("part").project("p_partkey", s=text.substring(c("p_name"), -1, 3))


@rel("f5_extract", "select o_orderkey, extract(year from o_orderdate) as y, extract(month from o_orderdate) as m, extract(day from o_orderdate) as d from orders")
def _(t):
    return t("orders").project("o_orderkey", **{k[0]: dates.part(k, c("o_orderdate")) for k in ("year", "month", "day")})


sql("f5_date_part", "select count(*) as n from orders where date_part('year', o_orderdate) = 1997 and extract(month from o_orderdate) < 4")
sql("f6_constant_extracts", "select extract(year from o_orderdate) as y, extract(month from o_orderdate) as m, extract(day from o_orderdate) as d, count(*) as n from orders where extract(day from o_orderdate) <= 15 group by extract(year from o_orderdate), extract(month from o_orderdate), extract(day from o_orderdate)", "select cast(extract(year from o_orderdate) as integer) as y, cast(extract(month from o_orderdate) as integer) as m, cast(extract(day from o_orderdate) as integer) as d, count(*) as n from orders where extract(day from o_orderdate) <= 15 group by 1, 2, 3")
sql("f7_numeric_cast", "select o_totalprice::numeric(12,1) as a, o_custkey::numeric(10,2) as b from orders")
sql("f8_text_casts", "select o_orderkey::text as a, cast(o_orderstatus as varchar(10)) as b, o_orderpriority::char(20) as d, o_custkey::bpchar as e from orders", "select cast(o_orderkey as varchar) as a, o_orderstatus as b, o_orderpriority as d, cast(o_custkey as varchar) as e from orders")
sql("f9_number_casts", "select p_partkey::int4 as a, p_size::int8 as b, p_size::float4 as d, p_partkey::float8 as e, p_size::int2 as f from part")
sql("f10_text_io", "select cast(cast(p_size as text) as int) as a, cast('1' || cast(p_size as text) as bigint) as b from part")


@rel("f11_truncating_casts", "select cast(trunc(p_retailprice) as integer) as a, cast(trunc(-p_retailprice) as bigint) as b, cast(p_size as double) as d, cast(o as decimal(10,1)) as e from (select *, p_size * 1.0 as o from part)")
def _(t):
    return t("part").project(a=numeric.to_int(c("p_retailprice")), b=numeric.to_int(-c("p_retailprice"), "bigint"), d="cast(p_size as double)", e="cast(p_size as decimal(10,1))")


sql("f11_date_timestamp_casts", "select cast(o_orderdate as date) as d, cast(cast(o_orderdate as date) as timestamp) as t from orders")
sql("f12_string_casts", "select cast(' ' || cast(p_size as text) || ' ' as int) as a, cast('3.25' as double precision) as b, cast(p_size as text) || 'x' as d from part")


@rel("f13_date_functions", "select cast(cast(o_orderdate as date) + interval 10 day as date) as a, cast(cast(o_orderdate as date) - interval 10 day as date) as b from orders")
def _(t):
    return t("orders").project(a="date_add(cast(o_orderdate as date), 10)", b="date_sub(cast(o_orderdate as date), 10)")


sql("f14_like_and_concat", "select p_partkey, p_name like '%' || substring(p_brand, 7, 1) || '%' as a, p_name like 'b' || '%' as b, p_brand || ' ' || p_type || nullif(p_name, p_name) as c from part")
sql("f15_starts_ends", "select p_partkey, p_name like 'b%' as a, p_name like '%d' as b, p_name like '%lu%' as d from part")
sql("f16_length_trim", "select cast(length(p_name) as bigint) as n, trim('  ' || p_brand || ' ') as t, ltrim('  ' || p_brand) as l, rtrim(p_brand || '  ') as r, concat(p_brand, '/', p_type) as k from part")
sql("f16_ilike", "select p_partkey from part where p_type ilike 'promo%' or p_name ~~* '%RED%'", "select p_partkey from part where p_type ilike 'promo%' or p_name ilike '%RED%'")


@rel("f17_dump_values", "select cast(n_nationkey as varchar) || '|' || n_name || '|' || coalesce(cast(nullif(n_regionkey, 3) as varchar), 'NULL') as line from nation")
def _(t):
    return t("nation").project(line=F.to_csv(F.struct("n_nationkey", "n_name", F.expr("nullif(n_regionkey, 3)")), {"sep": "|", "nullValue": "NULL"}))


@rel("f18_hash_groups", "select count(*) as n from (select distinct o_custkey, o_orderstatus from orders)")
def _(t):
    return t("orders").project(h="xxhash64(o_custkey, o_orderstatus)").distinct().aggregate(n="count(*)")


sql("f19_null_handling", "select n_nationkey, coalesce(nullif(n_regionkey, 2) > 1, false) as t, nullif(n_regionkey, 2) as v from nation where nullif(n_regionkey, 2) is not null or n_nationkey < 3")
