"""Every registered query against its SQL twin, and the plans of the main ones."""

import pytest
from compare import difference, duck
from conftest import SMALL

import __spark_entry__ as entry
from fleetgauge.plans import oracle
from fleetgauge.plans import queries as plans

# Queries of the training-data subpackage have tests of their own.
QUERIES, TWINS = plans.QUERIES, oracle.ORACLE


@pytest.fixture(scope="module")
def connection():
    return duck(SMALL)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)
    assert set(QUERIES) <= set(entry.queries()) and set(TWINS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, connection, name):
    assert difference(connection, TWINS[name], QUERIES[name](spark, SMALL)) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and list(rows[0].asDict()) == ["query", "exec_count", "total_wait_sec", "avg_ms", "sum_rows_examined"]


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("stream_", "counter_rate", "write_", "read_lake", "compact_", "json_report"))])
def test_plans_hold_no_python_and_no_pairs(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(bad in plan for bad in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))
