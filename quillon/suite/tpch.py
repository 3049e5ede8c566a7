"""The 22 TPC-H queries, over the star schema at hand.

Columns and tables that the data lacks are derived by rules from those it has (the same rules in both
dialects): partsupp from the parts and suppliers of line items, dates, priorities and texts from keys.
Money becomes decimal(12,2) and dates become DATE, as in the benchmark's own schema.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import registry
from quillon.session import Engine
from quillon.sources import tables

#: Values of derived columns, in the order in which keys pick them; fixed values.
SHIPMODES = ("AIR", "REG AIR", "RAIL", "SHIP", "TRUCK", "MAIL", "FOB")
INSTRUCTIONS = ("DELIVER IN PERSON", "COLLECT COD", "NONE", "TAKE BACK RETURN")
CONTAINERS = ("SM CASE", "SM BOX", "MED BAG", "MED BOX", "LG CASE", "LG BOX", "JUMBO PACK", "WRAP JAR")
NATIONS = ("ALGERIA", "ARGENTINA", "BRAZIL", "CANADA", "EGYPT", "ETHIOPIA", "FRANCE", "GERMANY", "INDIA", "INDONESIA", "IRAN", "IRAQ", "JAPAN", "JORDAN", "KENYA", "MOROCCO", "MOZAMBIQUE", "PERU", "CHINA", "ROMANIA", "SAUDI ARABIA", "VIETNAM", "RUSSIA", "UNITED KINGDOM", "UNITED STATES")


def _pick(key: str, values: tuple[str, ...]) -> str:
    cases = " ".join(f"when {k} then '{v}'" for k, v in enumerate(values))
    return f"case {key} % {len(values)} {cases} end"


def views(days) -> dict[str, str]:
    """SQL of each table; days(date, n) adds n days in the dialect at hand."""
    ship = "cast(l_shipdate as date)"
    return {
        "t_region": "select r_regionkey, r_name from region",
        "t_nation": f"select n_nationkey, {_pick('n_nationkey', NATIONS)} as n_name, n_regionkey from nation",
        "t_supplier": "select s_suppkey, s_name, s_nationkey, cast(s_acctbal as decimal(12,2)) as s_acctbal, 'address ' || cast(s_suppkey as string) as s_address, cast(10 + s_nationkey as string) || '-' || cast(100 + s_suppkey % 900 as string) as s_phone, case when s_suppkey % 29 = 0 then 'Customer slow Complaints' else 'steady supply' end as s_comment from supplier",
        "t_customer": "select c_custkey, c_name, c_nationkey, cast(c_acctbal as decimal(12,2)) as c_acctbal, c_mktsegment, 'address ' || cast(c_custkey as string) as c_address, cast(10 + c_nationkey as string) || '-' || cast(100 + c_custkey % 900 as string) as c_phone, 'comment ' || cast(c_custkey % 7 as string) as c_comment from customer",
        "t_part": f"select p_partkey, p_name, 'Manufacturer#' || cast(1 + p_partkey % 5 as string) as p_mfgr, p_brand, p_type, p_size, {_pick('p_partkey', CONTAINERS)} as p_container, cast(p_retailprice as decimal(12,2)) as p_retailprice from part",
        "t_partsupp": "select l_partkey as ps_partkey, l_suppkey as ps_suppkey, cast(1 + (l_partkey * 31 + l_suppkey * 17) % 9999 as int) as ps_availqty, cast((100 + (l_partkey * 7 + l_suppkey * 13) % 99900) * 0.01 as decimal(12,2)) as ps_supplycost from lineitem group by l_partkey, l_suppkey",
        "t_orders": "select o_orderkey, o_custkey, o_orderstatus, cast(o_totalprice as decimal(12,2)) as o_totalprice, cast(o_orderdate as date) as o_orderdate, o_orderpriority, 0 as o_shippriority, case when o_orderkey % 11 = 0 then 'a special case of requests' else 'plain' end as o_comment from orders",
        "t_lineitem": f"select l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity as decimal(12,2)) as l_quantity, cast(l_extendedprice as decimal(12,2)) as l_extendedprice, cast(l_discount as decimal(12,2)) as l_discount, cast(l_tax as decimal(12,2)) as l_tax, l_returnflag, l_linestatus, {ship} as l_shipdate, {days(ship, '(l_orderkey * 7 + l_linenumber * 13) % 60 - 30')} as l_commitdate, {days(ship, '1 + (l_orderkey * 3 + l_linenumber * 11) % 30')} as l_receiptdate, {_pick('(l_orderkey + l_linenumber)', SHIPMODES)} as l_shipmode, {_pick('(l_orderkey + l_linenumber * 3)', INSTRUCTIONS)} as l_shipinstruct from lineitem",
    }


#: name -> (query, {column: type of the result}); money and ratios are compared as doubles, rounded.
QUERIES: dict[str, tuple[str, dict[str, str]]] = {
    "q01": (
        """select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, sum(l_extendedprice) as sum_base_price, sum(l_extendedprice * (1 - l_discount)) as sum_disc_price,
        sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) as sum_charge, avg(l_quantity) as avg_qty, avg(l_extendedprice) as avg_price, avg(l_discount) as avg_disc, count(*) as count_order
        from t_lineitem where l_shipdate <= date '1998-12-01' - interval '90' day group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus""",
        {"l_returnflag": "", "l_linestatus": "", "sum_qty": "2", "sum_base_price": "2", "sum_disc_price": "2", "sum_charge": "2", "avg_qty": "2", "avg_price": "2", "avg_disc": "2", "count_order": ""},
    ),
    "q02": (
        """select s_acctbal, s_name, n_name, p_partkey, p_mfgr, s_address, s_phone, s_comment from t_part, t_supplier, t_partsupp, t_nation, t_region
        where p_partkey = ps_partkey and s_suppkey = ps_suppkey and p_size = 15 and p_type like '%LL' and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'EUROPE'
        and ps_supplycost = (select min(ps_supplycost) from t_partsupp, t_supplier, t_nation, t_region where p_partkey = ps_partkey and s_suppkey = ps_suppkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'EUROPE')
        order by s_acctbal desc, n_name, s_name, p_partkey limit 100""",
        {"s_acctbal": "2", "s_name": "", "n_name": "", "p_partkey": "", "p_mfgr": "", "s_address": "", "s_phone": "", "s_comment": ""},
    ),
    "q03": (
        """select l_orderkey, sum(l_extendedprice * (1 - l_discount)) as revenue, o_orderdate, o_shippriority from t_customer, t_orders, t_lineitem
        where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate < date '1998-03-15' and l_shipdate > date '1998-03-15'
        group by l_orderkey, o_orderdate, o_shippriority order by revenue desc, o_orderdate limit 10""",
        {"l_orderkey": "", "revenue": "2", "o_orderdate": "", "o_shippriority": ""},
    ),
    "q04": (
        """select o_orderpriority, count(*) as order_count from t_orders where o_orderdate >= date '1997-07-01' and o_orderdate < date '1997-10-01'
        and exists (select * from t_lineitem where l_orderkey = o_orderkey and l_commitdate < l_receiptdate) group by o_orderpriority order by o_orderpriority""",
        {"o_orderpriority": "", "order_count": ""},
    ),
    "q05": (
        """select n_name, sum(l_extendedprice * (1 - l_discount)) as revenue from t_customer, t_orders, t_lineitem, t_supplier, t_nation, t_region
        where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA'
        and o_orderdate >= date '1996-01-01' and o_orderdate < date '1997-01-01' group by n_name order by revenue desc""",
        {"n_name": "", "revenue": "2"},
    ),
    "q06": (
        "select sum(l_extendedprice * l_discount) as revenue from t_lineitem where l_shipdate >= date '1996-01-01' and l_shipdate < date '1997-01-01' and l_discount between 0.06 - 0.01 and 0.06 + 0.01 and l_quantity < 24",
        {"revenue": "2"},
    ),
    "q07": (
        """select supp_nation, cust_nation, l_year, sum(volume) as revenue from (select n1.n_name as supp_nation, n2.n_name as cust_nation, extract(year from l_shipdate) as l_year, l_extendedprice * (1 - l_discount) as volume
        from t_supplier, t_lineitem, t_orders, t_customer, t_nation n1, t_nation n2 where s_suppkey = l_suppkey and o_orderkey = l_orderkey and c_custkey = o_custkey and s_nationkey = n1.n_nationkey and c_nationkey = n2.n_nationkey
        and ((n1.n_name = 'FRANCE' and n2.n_name = 'GERMANY') or (n1.n_name = 'GERMANY' and n2.n_name = 'FRANCE')) and l_shipdate between date '1995-01-01' and date '1998-12-31') as shipping
        group by supp_nation, cust_nation, l_year order by supp_nation, cust_nation, l_year""",
        {"supp_nation": "", "cust_nation": "", "l_year": "bigint", "revenue": "2"},
    ),
    "q08": (
        """select o_year, sum(case when nation = 'BRAZIL' then volume else 0 end) / sum(volume) as mkt_share from (select extract(year from o_orderdate) as o_year, l_extendedprice * (1 - l_discount) as volume, n2.n_name as nation
        from t_part, t_supplier, t_lineitem, t_orders, t_customer, t_nation n1, t_nation n2, t_region where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n1.n_nationkey
        and n1.n_regionkey = r_regionkey and r_name = 'AMERICA' and s_nationkey = n2.n_nationkey and o_orderdate between date '1995-01-01' and date '1998-12-31' and p_type = 'ECONOMY') as all_nations group by o_year order by o_year""",
        {"o_year": "bigint", "mkt_share": "4"},
    ),
    "q09": (
        """select nation, o_year, sum(amount) as sum_profit from (select n_name as nation, extract(year from o_orderdate) as o_year, l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity as amount
        from t_part, t_supplier, t_lineitem, t_partsupp, t_orders, t_nation where s_suppkey = l_suppkey and ps_suppkey = l_suppkey and ps_partkey = l_partkey and p_partkey = l_partkey and o_orderkey = l_orderkey and s_nationkey = n_nationkey and p_name like '%ed%') as profit
        group by nation, o_year order by nation, o_year desc""",
        {"nation": "", "o_year": "bigint", "sum_profit": "2"},
    ),
    "q10": (
        """select c_custkey, c_name, sum(l_extendedprice * (1 - l_discount)) as revenue, c_acctbal, n_name, c_address, c_phone, c_comment from t_customer, t_orders, t_lineitem, t_nation
        where c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate >= date '1996-10-01' and o_orderdate < date '1997-01-01' and l_returnflag = 'R' and c_nationkey = n_nationkey
        group by c_custkey, c_name, c_acctbal, c_phone, n_name, c_address, c_comment order by revenue desc limit 20""",
        {"c_custkey": "", "c_name": "", "revenue": "2", "c_acctbal": "2", "n_name": "", "c_address": "", "c_phone": "", "c_comment": ""},
    ),
    "q11": (
        """select ps_partkey, sum(ps_supplycost * ps_availqty) as value from t_partsupp, t_supplier, t_nation where ps_suppkey = s_suppkey and s_nationkey = n_nationkey and n_name = 'GERMANY'
        group by ps_partkey having sum(ps_supplycost * ps_availqty) > (select sum(ps_supplycost * ps_availqty) * 0.001 from t_partsupp, t_supplier, t_nation where ps_suppkey = s_suppkey and s_nationkey = n_nationkey and n_name = 'GERMANY') order by value desc""",
        {"ps_partkey": "", "value": "2"},
    ),
    "q12": (
        """select l_shipmode, sum(case when o_orderpriority = '1-URGENT' or o_orderpriority = '2-HIGH' then 1 else 0 end) as high_line_count, sum(case when o_orderpriority <> '1-URGENT' and o_orderpriority <> '2-HIGH' then 1 else 0 end) as low_line_count
        from t_orders, t_lineitem where o_orderkey = l_orderkey and l_shipmode in ('MAIL', 'SHIP') and l_commitdate < l_receiptdate and l_shipdate < l_commitdate and l_receiptdate >= date '1996-01-01' and l_receiptdate < date '1997-01-01' group by l_shipmode order by l_shipmode""",
        {"l_shipmode": "", "high_line_count": "bigint", "low_line_count": "bigint"},
    ),
    "q13": (
        """select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count from t_customer left outer join t_orders on c_custkey = o_custkey and o_comment not like '%special%requests%' group by c_custkey) as c_orders
        group by c_count order by custdist desc, c_count desc""",
        {"c_count": "", "custdist": ""},
    ),
    "q14": (
        """select 100.00 * sum(case when p_type like 'PROMO%' then l_extendedprice * (1 - l_discount) else 0 end) / sum(l_extendedprice * (1 - l_discount)) as promo_revenue from t_lineitem, t_part
        where l_partkey = p_partkey and l_shipdate >= date '1996-09-01' and l_shipdate < date '1996-10-01'""",
        {"promo_revenue": "3"},
    ),
    "q15": (
        """with revenue as (select l_suppkey as supplier_no, sum(l_extendedprice * (1 - l_discount)) as total_revenue from t_lineitem where l_shipdate >= date '1996-01-01' and l_shipdate < date '1996-04-01' group by l_suppkey)
        select s_suppkey, s_name, s_address, s_phone, total_revenue from t_supplier, revenue where s_suppkey = supplier_no and total_revenue = (select max(total_revenue) from revenue) order by s_suppkey""",
        {"s_suppkey": "", "s_name": "", "s_address": "", "s_phone": "", "total_revenue": "2"},
    ),
    "q16": (
        """select p_brand, p_type, p_size, count(distinct ps_suppkey) as supplier_cnt from t_partsupp, t_part where p_partkey = ps_partkey and p_brand <> 'Brand#5' and p_type not like 'MEDIUM%' and p_size in (49, 14, 23, 45, 19, 3, 36, 9)
        and ps_suppkey not in (select s_suppkey from t_supplier where s_comment like '%Customer%Complaints%') group by p_brand, p_type, p_size order by supplier_cnt desc, p_brand, p_type, p_size""",
        {"p_brand": "", "p_type": "", "p_size": "", "supplier_cnt": ""},
    ),
    "q17": (
        """select sum(l_extendedprice) / 7.0 as avg_yearly from t_lineitem, t_part where p_partkey = l_partkey and p_brand = 'Brand#13' and l_quantity < (select 0.5 * avg(l_quantity) from t_lineitem where l_partkey = p_partkey)""",
        {"avg_yearly": "2"},
    ),
    "q18": (
        """select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) as total_qty from t_customer, t_orders, t_lineitem where o_orderkey in (select l_orderkey from t_lineitem group by l_orderkey having sum(l_quantity) > 210)
        and c_custkey = o_custkey and o_orderkey = l_orderkey group by c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice order by o_totalprice desc, o_orderdate, o_orderkey limit 100""",
        {"c_name": "", "c_custkey": "", "o_orderkey": "", "o_orderdate": "", "o_totalprice": "2", "total_qty": "2"},
    ),
    "q19": (
        """select sum(l_extendedprice * (1 - l_discount)) as revenue from t_lineitem, t_part where (p_partkey = l_partkey and p_brand = 'Brand#12' and p_container in ('SM CASE', 'SM BOX') and l_quantity >= 1 and l_quantity <= 21 and p_size between 1 and 25 and l_shipmode in ('AIR', 'REG AIR'))
        or (p_partkey = l_partkey and p_brand = 'Brand#23' and p_container in ('MED BAG', 'MED BOX') and l_quantity >= 10 and l_quantity <= 30 and p_size between 1 and 40 and l_shipmode in ('AIR', 'REG AIR'))
        or (p_partkey = l_partkey and p_brand = 'Brand#3' and p_container in ('LG CASE', 'LG BOX') and l_quantity >= 20 and l_quantity <= 50 and p_size between 1 and 50 and l_shipmode in ('AIR', 'REG AIR'))""",
        {"revenue": "2"},
    ),
    "q20": (
        """select s_name, s_address from t_supplier, t_nation where s_suppkey in (select ps_suppkey from t_partsupp where ps_partkey in (select p_partkey from t_part where p_name like 'b%')
        and ps_availqty > (select 0.5 * sum(l_quantity) from t_lineitem where l_partkey = ps_partkey and l_suppkey = ps_suppkey and l_shipdate >= date '1996-01-01' and l_shipdate < date '1997-01-01')) and s_nationkey = n_nationkey and n_name = 'CANADA' order by s_name""",
        {"s_name": "", "s_address": ""},
    ),
    "q21": (
        """select s_name, count(*) as numwait from t_supplier, t_lineitem l1, t_orders, t_nation where s_suppkey = l1.l_suppkey and o_orderkey = l1.l_orderkey and o_orderstatus = 'F' and l1.l_receiptdate > l1.l_commitdate
        and exists (select * from t_lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey) and not exists (select * from t_lineitem l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.l_receiptdate > l3.l_commitdate)
        and s_nationkey = n_nationkey and n_name = 'SAUDI ARABIA' group by s_name order by numwait desc, s_name limit 100""",
        {"s_name": "", "numwait": ""},
    ),
    "q22": (
        """select cntrycode, count(*) as numcust, sum(c_acctbal) as totacctbal from (select substring(c_phone from 1 for 2) as cntrycode, c_acctbal from t_customer where substring(c_phone from 1 for 2) in ('13', '31', '23', '29', '30', '18', '17')
        and c_acctbal > (select avg(c_acctbal) from t_customer where c_acctbal > 0.00 and substring(c_phone from 1 for 2) in ('13', '31', '23', '29', '30', '18', '17')) and not exists (select * from t_orders where o_custkey = c_custkey and o_orderkey % 9 = 0)) as custsale
        group by cntrycode order by cntrycode""",
        {"cntrycode": "", "numcust": "", "totacctbal": "2"},
    ),
}


def partsupp(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """t_partsupp, a base table of the benchmark: written once a session and folder, bucketed by ps_partkey (files that change within a session are not seen)."""
    name = "quillon_partsupp_" + hashlib.sha256(f"{spark.sparkContext.applicationId} {sf_dir}".encode()).hexdigest()[:16]
    if not spark.catalog.tableExists(name):
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{tables.work_dir(spark)}/{name}-{uuid.uuid4().hex}"
        tables.write_bucketed(spark.sql(text).repartition(buckets, "ps_partkey"), name, ["ps_partkey"], buckets, path=path)
    return spark.table(name)


def engine(spark: SparkSession, sf_dir: str, query: str = "") -> Engine:
    """An engine with the benchmark's tables over a folder's; with a query, only with those that it names."""
    e = Engine(spark)
    for name, text in views(lambda d, n: f"date_add({d}, cast({n} as int))").items():
        if not query or re.search(rf"\b{name}\b", query):
            e.load(sf_dir, [text.rpartition(" from ")[2].split()[0]])
            e.register(name, partsupp(spark, sf_dir, text) if name == "t_partsupp" else spark.sql(text))
    return e


def run(name: str):
    text, columns = QUERIES[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = engine(spark, sf_dir, text).sql(text)
        kind = {"": lambda c: F.col(c), "bigint": lambda c: F.col(c).cast("bigint")}
        return out.select(*(kind.get(k, lambda c, k=k: F.round(F.col(c).cast("double"), int(k)))(c).alias(c) for c, k in columns.items()))

    return query


def twin(name: str) -> str:
    text, columns = QUERIES[name]
    given = [f"{n} as ({t})" for n, t in views(lambda d, n: f"({d} + cast({n} as integer))").items()]
    shown = [c if not k else f"cast({c} as bigint) as {c}" if k == "bigint" else f"round(cast({c} as double), {k}) as {c}" for c, k in columns.items()]
    return f"with {', '.join(given)} select {', '.join(shown)} from ({text}) as q"


for _name in QUERIES:
    registry.add(f"tpch_{_name}", run(_name), twin(_name))
