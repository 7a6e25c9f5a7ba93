import pytest

from skerry.plans import registry
from tests.oracle import connect, differences

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_its_text(spark, small, con, name):
    assert differences(QUERIES[name](spark, small), con, ORACLE[name]) == ([], [])


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
