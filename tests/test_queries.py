import pytest

from tallyframe.plans import registry

from .oracle import compare, duck

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(D)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, registry.queries()[name], registry.oracle_sql()[name], D) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_has_rows(spark, name):
    assert registry.queries()[name](spark, D).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
