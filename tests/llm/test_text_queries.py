import pytest

from skerry.llm import registry
from tests.oracle import connect, differences

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_its_text(spark, small, con, name):
    assert differences(QUERIES[name](spark, small), con, ORACLE[name]) == ([], [])


def test_limits_of_containers_are_reached_and_kept(spark):
    rows = QUERIES["p6_limits"](spark, "/root/testdata/sf0.01").collect()
    assert rows and all(r.over == 0 for r in rows) and sum(r.most_documents for r in rows) and sum(r.most_attention for r in rows)


def test_texts_are_the_characters_of_their_units(spark, small):
    got = QUERIES["p8_texts"](spark, small).drop("unit")
    assert got.exceptAll(QUERIES["p8_found"](spark, small)).isEmpty()
