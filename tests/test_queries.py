import pytest
from oracle import DATA, assert_same, connection

from evalspan.plans import registry


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert_same(registry.QUERIES[name](spark, DATA), registry.ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert df.columns
    df.collect()
