import json

import pytest
from pyspark.sql import functions as F

from evaquery import __main__ as cli
from evaquery.functions.schemas import validated
from evaquery.plans import builder, reexport
from evaquery.sources import documents


def line(id_, kind, points, **attributes):
    return {"id": id_, "level": "L00", "sourceType": kind, "geometry": {"type": "LineString", "coordinates": points}, "attributes": attributes}


def area(id_, points, **attributes):
    return {"id": id_, "level": "L00", "sourceType": "room_polygon", "geometry": {"type": "Polygon", "coordinates": [[*points, points[0]]]}, "attributes": attributes}


MODEL = {
    "id": "M1", "metadata": {"name": "house"},
    "sourceFeatures": [
        area("SF_1", [[0, 0], [4, 0], [4, 3], [0, 3]], originalType="space", originalName="A"), area("SF_2", [[5, 0], [9, 0], [9, 3], [5, 3]], originalType="space"),
        line("SF_3", "door_centerline", [[4, 1.5], [5, 1.5]], thicknessM=1.0), line("SF_4", "wall_centerline", [[0, -2], [9, -2]], originalType="muro_exterior", thicknessM=0.2),
        line("SF_5", "wall_centerline", [[0, 0]]), {"id": "SF_6", "level": "L00", "sourceType": "note"},
    ],
}


@pytest.fixture
def path(tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(MODEL, indent=1))
    return str(tmp_path / "m.json")


def test_documents_give_back_their_features(spark, path):
    kept = documents.source_features(spark, path)
    got = {r.name: (r.kind, len(r.ring), r.thickness) for r in reexport.features(kept).collect()}
    assert got == {"A": ("space", 4, None), "SF_2": ("space", 4, None), "SF_3": ("puerta_simple", 2, 1.0), "SF_4": ("muro_exterior", 2, 0.2)}
    assert reexport.canvas(kept).first()[1:] == (9.0, 3.0)
    cells, bounds = reexport.rebuilt(kept)
    assert sorted(r.category for r in cells.collect()) == ["Door", "Room", "Room", "WallSegment"]
    again = reexport.sources(reexport.features(kept))
    cells2, bounds2 = reexport.rebuilt(again)
    assert sorted(map(tuple, cells2.collect()), key=str) == sorted(map(tuple, cells.collect()), key=str)
    assert sorted(map(tuple, bounds2.collect()), key=str) == sorted(map(tuple, bounds.collect()), key=str) and bounds.count() == 2


def test_command_line(spark, path, tmp_path, capsys):
    assert cli.main(["reexport", path, str(tmp_path / "out")]) == 0
    made = documents.models(spark, str(tmp_path / "out"), lines=True)
    assert made.first().modelName == "house" and documents.cells(made).count() == 4 and documents.edges(made).count() == 2
    (tmp_path / "s.json").write_text(json.dumps({"type": "object", "required": ["id", "levels"]}))
    assert cli.main(["validate", path, "--schema", str(tmp_path / "s.json")]) == 2 and "lacks levels" in capsys.readouterr().out
    (tmp_path / "s.json").write_text("{}")
    assert cli.main(["validate", path, "--schema", str(tmp_path / "s.json")]) == 0
    (tmp_path / "e.json").write_text("{}")
    assert cli.main(["reexport", str(tmp_path / "e.json"), str(tmp_path / "none")]) == 1
    assert cli.main(["queries"]) == 0 and "v03_room_graph" in capsys.readouterr().out


def test_schema_keywords():
    schema = {"type": ["object", "null"], "properties": {"a": {"oneOf": [{"type": "integer"}, {"type": "number", "minimum": 5}]}, "b": {"anyOf": [{"const": 1}, {"const": 2}]}, "c": {"allOf": [{"type": "array"}, {"maxItems": 1, "uniqueItems": True}]}, "d": {"$ref": "#/$defs/d"}}, "additionalProperties": {"type": "string"}, "$defs": {"d": {"enum": [True, None]}}}
    assert validated("null", schema) == [] and validated('{"a": 3, "b": 2, "c": [1], "d": null, "z": "x"}', schema) == []
    assert validated('{"a": 7}', schema) == [("$.a", "fits 2 of the 2 ways of oneOf")]
    assert validated('{"b": 3, "c": [1, 1], "d": 0, "z": 1}', schema) == [("$.b", "fits 0 of the 2 ways of anyOf"), ("$.c", "has more than 1 items"), ("$.c", "repeats an item"), ("$.d", "is none of [true, null]"), ("$.z", "is not of type string")]
    assert validated("[", {}) == validated(None, {}) == [("$", "is no JSON")]
    assert validated('{"items": [{"n": 1.5}, {"n": 2}]}', {"properties": {"items": {"items": {"properties": {"n": {"type": "integer"}}}}}}) == [("$.items[0].n", "is not of type integer")]


def test_models_with_levels_of_one_name_stay_apart(spark):
    box = lambda x: [[float(x), 0.0], [x + 4.0, 0.0], [x + 4.0, 3.0], [float(x), 3.0]]
    rows = [(m, "L00", "space", "A", box(0), None, None, None) for m in ("M1", "M2")] + [("M2", "L00", "space", "B", box(4), None, None, None)]
    f = spark.createDataFrame(rows, "model string, " + builder.FEATURE)
    cells = builder.cells(f)
    assert sorted((r.model, r.cell, r.area) for r in cells.collect()) == [("M1", "CS_M1_L00_ROOM_001", 12.0), ("M2", "CS_M2_L00_ROOM_001", 12.0), ("M2", "CS_M2_L00_ROOM_002", 12.0)]
    assert [r.model for r in builder.contacts(cells, f).collect()] == ["M2"]
    outer = cells.where("model = 'M2'").withColumn("navigation_type", F.lit("NonNavigableSpace")).withColumn("function", F.lit("Wall")).withColumn("source_wall_types", F.array(F.lit("muro_exterior")))
    lines = builder.exterior_boundaries(outer, builder.contacts(cells, f)).collect()
    assert len(lines) == 6 and len({r.boundary for r in lines}) == 6 and not any(r.ax == r.bx == 4.0 for r in lines)
