"""Every registered query of the library against its SQL twin in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from quillon import registry

SF = "/root/testdata/sf0.001"
QUERIES, TWINS = registry.queries(), registry.oracle_sql()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "smallint": "SMALLINT", "float": "FLOAT", "array<string>": "VARCHAR[]"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return c


def test_each_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(TWINS[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    types = dict(zip(want.columns, map(str, want.types)))
    for field in df.schema:
        kind = field.dataType.simpleString()
        assert KINDS.get(kind, kind.upper()) == types[field.name], field
    rows = sorted(repr([r[c] for c in columns]) for r in df.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr([r[k] for k in at]) for r in want.fetchall())
