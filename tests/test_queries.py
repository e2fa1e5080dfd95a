import pytest

from tests.oracle import DATA, check
from tidemark.queries import oracle_sql, queries

SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    check(spark, queries()[name], SQL[name])


def test_every_query_runs(spark):
    for name in sorted(set(queries()) - set(SQL)):
        assert queries()[name](spark, DATA).count() > 0


def test_sketch_is_near(spark):
    exact = {r["bucket"]: r["value"] for r in queries()["events_uniques_day"](spark, DATA).collect()}
    near = {r["bucket"]: r["value"] for r in queries()["events_uniques_approx"](spark, DATA).collect()}
    assert exact.keys() == near.keys() and all(abs(near[k] - v) <= 0.1 * v + 1 for k, v in exact.items())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 30
