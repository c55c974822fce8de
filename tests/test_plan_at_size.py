import pytest

from evaquery import catalog
from evaquery.operators import dq
from evaquery.sources import domain

SF = "/root/testdata/sf0.001"


def test_what_spawn_points_meet_is_not_broadcast_while_the_query_runs(spark):
    df = catalog.QUERIES["b23_v2_spawns"](spark, SF)
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["b09_b10_a02_exposed_borders", "q17_opening_rules", "a06_document_counts", "b23_v2_spawns"])
def test_parts_are_dealt_before_they_are_a_floor_plan(spark, name, monkeypatch):
    """A file of many parts may be one split, whose task would hold the groups of all of them."""
    monkeypatch.setattr(domain, "PLAN_PARTS", 50, raising=False)
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan" in x and "p_partkey" in x]
    assert scans and plan.count("REPARTITION_BY_NUM") >= len(scans)


@pytest.mark.parametrize("name", ["q05_unique_keys", "q06_foreign_keys"])
def test_keys_of_many_rows_are_dealt_by_their_number(spark, name, monkeypatch):
    whole = sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(dq, "KEY_ROWS", 100, raising=False)
    df = catalog.QUERIES[name](spark, SF)
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.collect())) == whole
