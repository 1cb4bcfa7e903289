"""Every registered query against its SQL on the smallest tables, and its plan."""

import os

import pytest

from checks.catalog import ORACLES, QUERIES
from checks.compare import compare, database

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql_without_pairwise_join(spark, con, name):
    df = QUERIES[name](spark, SF)
    outcome = compare(con, name, df)
    assert outcome.startswith("ok" if name in ORACLES else "rows only"), outcome
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan


def test_thinning_limits_groups_before_the_shuffle(spark):
    plan = QUERIES["daily_thin"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_time_range_reaches_the_scan(spark):
    plan = QUERIES["time_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
