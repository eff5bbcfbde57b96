import pytest

from millcheck.llm import queries
from tests.test_queries import compare, duck  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):  # noqa: F811
    compare(spark, duck, queries.queries()[name], queries.oracle_sql()[name])


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
