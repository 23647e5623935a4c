"""Every core query with SQL gives the same rows on the smallest tables."""

import os

import duckdb
import pytest

from compare import canonical, connect
from sparkloom.plans import registry

PATH = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="no test tables")


@pytest.fixture(scope="module")
def sql_tables():
    return connect(PATH)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, sql_tables: duckdb.DuckDBPyConnection, name):
    got = registry.queries()[name](spark, PATH).toPandas()
    want = sql_tables.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
