import duckdb
import pytest

from tests.helpers import against_sql, views
from tracewright.llm import queries

QUERIES = queries.queries()
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    con = duckdb.connect()
    views(con, data)
    against_sql(spark, con, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_registered():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
