"""Every query with an SQL counterpart against it, and the rest for running at all."""

import duckdb
import pytest

from tests.helpers import against_sql, views
from tracewright.plans import graph, graph_sql, prepared, prepared_sql

QUERIES = {**prepared.queries(), **graph.queries()}
SQL = {**prepared_sql.oracle_sql(), **graph_sql.oracle_sql()}


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    views(c, data)
    return c


@pytest.fixture(scope="module", autouse=True)
def snapshots_once():
    """Snapshots and chunks are cut once for all queries that start from them."""
    kept, made = {}, {n: getattr(graph, n) for n in ("snapped", "members_of")}

    def snapped(spark, sf_dir, nodes=graph.NODES):
        if ("s", sf_dir, nodes) not in kept:
            kept["s", sf_dir, nodes] = made["snapped"](spark, sf_dir, nodes)
        return kept["s", sf_dir, nodes]

    def members_of(snaps):
        if ("m", id(snaps)) not in kept:
            kept["m", id(snaps)] = made["members_of"](snaps)
        return kept["m", id(snaps)]

    graph.snapped, graph.members_of = snapped, members_of
    yield
    graph.snapped, graph.members_of = made["snapped"], made["members_of"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, data, name):
    against_sql(spark, con, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_needs_no_optional_part(spark, data):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
