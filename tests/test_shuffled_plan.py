import pytest

from evaquery import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["j20_transfer_membership", "f35_x07_edge_modes", "j15_cells_near_fires", "j22_best_two_cells", "f34_b10_exterior_boundaries", "b23_b25_v2_graph", "s02_s04_s18_model_round_trip", "b11_dual_edges"])
def test_the_floor_plan_is_not_broadcast_by_the_size_of_its_file(spark, name):
    """A part makes three rows or more, so an estimate from the file of parts is far too low."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "BroadcastHashJoin" not in plan
