"""The subpackage's queries against their SQL."""

import pytest

from tests.oracle import check
from tidemark.llm.queries import oracle_sql, queries

SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    check(spark, queries()[name], SQL[name])


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
