"""Every named query with a check, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    session = duckdb.connect()
    session.execute("set timezone='UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        session.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return session


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_check(spark, con, name):
    found = entry.queries()[name](spark, FOLDER)
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, found.collect()) == rows(columns, result.fetchall())


def test_every_query_has_a_callable_and_checks_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
