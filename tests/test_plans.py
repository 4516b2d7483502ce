"""Plan properties every registered query keeps: no cartesian or nested-loop joins, and filters
of selective questions reach the Parquet scan."""

import pytest

import __spark_entry__ as E

from .conftest import SMOKE


def _plan(spark, name):
    return E.queries()[name](spark, SMOKE)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_filters_pushed_and_columns_pruned(spark):
    plan = _plan(spark, "q_path2_named")
    assert "EqualTo(c_name,Customer#000000007)" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_orderpriority:string>" in plan
    plan = _plan(spark, "graph_refresh")
    assert "GreaterThanOrEqual(l_shipdate" in plan
