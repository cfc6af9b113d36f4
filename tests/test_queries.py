import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry_points

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


CORE = sorted(entry_points.QUERIES)


def test_every_query_has_its_sql():
    assert set(CORE) == set(entry_points.ORACLES)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.columns == ["room_id", "in_room", "occupied_pct", "window_seconds"]
    assert result.count() > 0


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, duck, name):
    good, note = compare(spark, duck, name, SF_DIR)
    assert good, note


BATCH = [name for name in CORE if name[0] in "avfmo" and name not in ("f6_stream_feed",)]


@pytest.mark.parametrize("name", BATCH)
def test_plan_has_no_pairwise_join_and_no_python(spark, name):
    plan = entry_points.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert name == "f3_fall_outcomes" or "Python" not in plan and "InPandas" not in plan
