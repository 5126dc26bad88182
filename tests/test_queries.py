"""Every registered query against its SQL on the smallest given tables."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_point

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    # a value halfway between two sixth decimals may round either way
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF, atol=1.01e-6) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, name):
    assert len(QUERIES[name](spark, SF).take(1)) == 1


def test_entry_and_names():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 150
