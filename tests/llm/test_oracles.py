import pytest

from sigmalake.llm import queries
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, sf, name):
    check(spark, queries.QUERIES[name], queries.ORACLES[name], sf)
