"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert oracle.compare(got, con.execute(SQL[name]).df()) is None
    else:
        assert len(got) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
