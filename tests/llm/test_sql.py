import pytest

from tallyframe.llm import queries

from ..oracle import compare, duck

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(D), queries.queries()[name], queries.oracle_sql()[name], D) == ""
