"""Sources and sinks: Parquet tables with declared schemas, inline values, delimited dumps."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Columns of the tables that tests and benchmarks read; a scan with a declared schema opens no footers to plan.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; columns and filters of what follows reach the reader."""
    reader = spark.read
    return (reader.schema(SCHEMAS[name]) if name in SCHEMAS else reader).parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, schema: str | T.StructType, rows: Iterable[Sequence]) -> DataFrame:
    """An inline relation."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def one_row(spark: SparkSession) -> DataFrame:
    """The input of a query without FROM."""
    return spark.range(1).select()


def scan_delimited(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = "|", null: str = "\\N") -> DataFrame:
    """A dump with one row a line, fields split by sep; a trailing separator is allowed."""
    return spark.read.schema(schema).option("sep", sep).option("nullValue", null).option("mode", "PERMISSIVE").csv(path)


def work_dir(spark: SparkSession) -> str:
    """A folder that all executors share, for files between steps: spark.checkpoint.dir, else (local mode) a temporary one; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = (), **options: str) -> None:
    """A sink: parquet, orc, json or csv files, by folders of partition_by if given."""
    df.write.mode(mode).format(kind).partitionBy(*partition_by).options(**options).save(path)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, mode: str = "errorifexists", path: str | None = None) -> None:
    """A table bucketed and sorted by keys: joins and groupings on them need no exchange. path: its folder, else the warehouse's."""
    writer = df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(table)
