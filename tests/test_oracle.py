"""Every query that has SQL gives the same rows, column names and types as that SQL."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def sql(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, 0.0, "")
    return (1, float(value), "") if isinstance(value, (bool, int, float)) else (2, 0.0, str(value))


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sql, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = sql.execute(ORACLES[name])
    columns = {d[0]: str(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == columns
    assert table(df.columns, df.collect()) == table(list(columns), want)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 10 and rows[0]["score"] >= rows[-1]["score"]
