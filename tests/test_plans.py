"""Scale guards on every registered query's physical plan."""

from __future__ import annotations

import pytest

from tracefold.plans.catalog import all_queries

QUERIES = all_queries()
FORBIDDEN = {
    "CartesianProduct": "no Cartesian products",
    "BroadcastNestedLoopJoin": "no nested-loop (non-equi) joins",
    "BatchEvalPython": "no row-at-a-time Python UDFs",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_forbidden_operators(spark, sf001, name):
    plan = QUERIES[name].fn(spark, sf001)._jdf.queryExecution().executedPlan().toString()
    bad = [why for op, why in FORBIDDEN.items() if op in plan]
    assert not bad, f"{name}: {bad}"


def test_scans_prune_columns(spark, sf001):
    # a 2-column question must not read every column of the task table
    df = QUERIES["A10_launch_per_stage"].fn(spark, sf001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "metrics" not in plan.split("ReadSchema", 1)[1].split("\n", 1)[0]


def test_repartition_spreads_a_hot_flag(spark, sf001):
    # rows move by a spread key, the flag's rows only after they are added up
    plan = QUERIES["D4_repartition_cache"].fn(spark, sf001)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "hashpartitioning" in x]
    assert len(moved) == 2 and "l_orderkey" in moved[1] and "partial_count" in plan.split(moved[0])[1].split(moved[1])[0]
