"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import differences

import __spark_entry__ as entry

from lodeline.plans import ORACLES as SQL
from lodeline.plans import QUERIES


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() == 20 and "match_count" in frame.columns


def test_every_query_has_its_sql():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == set()


PLAN_FREE_OF = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tiny, name):
    def look(frame):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert [word for word in PLAN_FREE_OF if word in plan] == []

    found = differences(spark, tiny, QUERIES[name], SQL[name], look)
    assert found == []


def test_scans_read_needed_columns_and_push_filters(spark, tiny):
    plan = QUERIES["changed_since"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "o_comment" not in plan and "o_totalprice" not in plan
    plan = QUERIES["project_filter"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src3)" in plan
