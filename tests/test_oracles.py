"""Every registered query runs; those with SQL equal it on the smallest tables."""

import pytest

from check import compare, duck
from wattloom.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = df.toPandas()
    if name in ORACLES:
        assert compare(got, con.execute(ORACLES[name]).df()) == ""


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_time_filter_reaches_the_scan(spark):
    plan = QUERIES["flt_time_slice"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed
    assert "props" not in plan.split("ReadSchema: ")[1].split("\n")[0]


@pytest.mark.parametrize("name, most", [("pipe_features_v4", 9), ("pipe_quality", 7), ("agg_block_mape", 5), ("win_impute", 5)])
def test_shuffles_stay_few(spark, name, most):
    """Detectors and features of a meter share one partitioning; the rest builds the views."""
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= most
