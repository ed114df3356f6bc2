"""Every query of the subpackage against its SQL."""

import pytest
from oracle import DATA, assert_same, connection

from evalspan.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, DATA), queries.ORACLES[name], connection())
