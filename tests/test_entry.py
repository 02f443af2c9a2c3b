"""The driver contract: every registered query against its SQL twin in DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from lodestar.queries import QUERIES as LIBRARY

SF_DIR = "/root/testdata/sf0.001"
# The text operators have tests of their own.
QUERIES = {name: entry_module.queries()[name] for name in LIBRARY}
ORACLE = {name: sql for name, sql in entry_module.oracle_sql().items() if name in LIBRARY}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    result = duck.execute(ORACLE[name])
    assert sorted(c[0] for c in result.description) == columns
    order = [[c[0] for c in result.description].index(name) for name in columns]
    expected = sorted(tuple(row[i] for i in order) for row in result.fetchall())
    assert sorted(tuple(row) for row in df.select(*columns).collect()) == expected
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan
    assert "props" not in plan  # only the columns in use are read


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
