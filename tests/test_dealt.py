import numpy as np
import pandas as pd
import pytest

from evaquery import catalog
from evaquery.functions import shapes
from evaquery.plans import builder
from evaquery.sources import storage

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["g05_g06_g07_g28_set_operations", "g30_g32_g33_b19_q15_decompositions", "g39_b24_tile_chains", "g29_faces", "g40_ways_inside"])
def test_shapes_are_dealt_before_any_python(spark, name, monkeypatch):
    """A file of many rows is one or two splits: without dealing one task does all the Python."""
    monkeypatch.setattr(storage, "TASK_ROWS", 50)
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "REPARTITION_BY_NUM" in plan
    assert plan.rindex("ArrowEvalPython") < plan.index("REPARTITION_BY_NUM")  # nothing of it is below the exchange


def test_shapes_that_a_batch_repeats_are_worked_out_once():
    asked = []
    ring = lambda z: np.array([np.array([0.0, z]), np.array([1.0, 0.0])], dtype=object)
    rows = pd.Series([np.array([r for r in ring(z)] + [None], dtype=object) for z in (0.0, 0.0, -0.0, 2.0)])
    made = shapes._once(lambda r, t: asked.append(t) or (len(asked), t), rows, pd.Series(["a", "a", "a", "a"]))
    assert list(made) == [(1, "a"), (1, "a"), (2, "a"), (3, "a")]


def test_a_shape_that_another_function_has_made_is_a_list_and_is_worked_out():
    asked = []
    made = shapes._once(lambda r: asked.append(r) or len(asked), pd.Series([[[0.0, 1.0]], [[0.0, 1.0]], [[-0.0, 1.0]], [], None]))
    assert list(made) == [1, 1, 2, 3, 4]


def test_functions_of_shapes_take_what_others_make(spark):
    square = spark.range(3).selectExpr("array(array(0D, 0D), array(2D, 0D), array(2D, 1D), array(2D, 2D), array(0D, 2D)) AS r")
    assert [row.a for row in square.select(shapes.area(shapes.clean(square.r)).alias("a")).collect()] == [4.0] * 3


def test_levels_are_dealt_by_their_number_not_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(builder, "LEVEL_ROWS", 10, raising=False)
    plan = catalog.QUERIES["b18_q16_detected_spaces"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan


def test_a_table_with_more_rows_than_are_broadcast_is_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 3)
    plan = lambda n: spark.range(9).join(storage.small(spark.range(n)), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(3) and "BroadcastHashJoin" not in plan(4)
