import pytest
from pyspark.sql import functions as F

from evaquery.functions import polygon as P
from evaquery.operators import dq
from evaquery.plans import builder, views


def sq(x, y, w, h=None):
    h = h or w
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]


def frame(spark, *rows):
    """Rows of (kind, name, ring, thickness, width, host) on level L00."""
    return spark.createDataFrame([("L00", k, n, [[float(c) for c in p] for p in r], *map(lambda v: None if v is None else float(v), (t, w)), h) for k, n, r, t, w, h in rows], builder.FEATURE)


def line(kind, name, ax, ay, bx, by, thickness=0.2, width=None, host=None):
    return (kind, name, [[ax, ay], [bx, by]], thickness, width, host)


def space(name, ring):
    return ("space", name, ring, None, None, None)


def built(spark, *rows):
    f = frame(spark, *rows)
    cells = builder.cells(f).cache()
    contacts = builder.contacts(cells, f)
    return cells, builder.boundaries(cells, contacts).cache(), contacts


def check_sound(cells):
    rings = [[tuple(p) for p in r.ring] for r in cells.collect()]
    assert all(P.total(P.intersection(P.convex_parts(a), P.convex_parts(b))) <= 1e-6 for i, a in enumerate(rings) for b in rings[i + 1 :])


@pytest.fixture(scope="module")
def two_by_virtual(spark):
    return built(spark, space("A", sq(0, 0, 2)), space("B", sq(2, 0, 2)), ("frontera_virtual", "V", [[2, 0], [2, 2]], None, None, None))


def test_virtual_boundary(two_by_virtual):
    cells, bounds, _ = two_by_virtual
    assert bounds.where("is_virtual").count() == 1 and cells.count() == 2
    assert views.space_adjacency(cells, bounds).count() == 1
    assert views.room_adjacency(cells, bounds).count() == 0
    nodes, edges = views.space_connectivity(cells, bounds)
    assert nodes.where("navigation_type = 'VirtualTransferNode'").count() == 1 and edges.count() == 2
    assert views.VIEWS["space_transfer_connectivity"] is views.VIEWS["room_transfer_connectivity"] is views.space_connectivity
    assert views.room_nodes(cells, bounds).first().cells == sorted(r.cell for r in cells.collect())


def test_doors(spark):
    door = lambda n, y: line("puerta_simple", n, 2, y, 3, y, 1.0)
    cells, bounds, _ = built(spark, space("A", sq(0, 0, 2, 3)), space("B", sq(3, 0, 2, 3)), door("D1", 0.75), door("D2", 2.25))
    assert views.space_connectivity(cells, bounds)[1].count() == 4
    assert views.space_adjacency(cells, bounds).first().kinds == ["transfer"]
    d2d = views.door_to_door(cells, bounds)
    assert d2d.count() == 2 and {r.distance for r in d2d.collect()} == {1.5}
    assert views.transfer_to_transfer(cells, bounds).count() == 2
    assert views.room_to_room(cells, bounds).count() == 1


def test_window_is_no_way(spark):
    cells, bounds, _ = built(spark, space("A", sq(0, 0, 2)), space("B", sq(2, 0, 2)), ("frontera_virtual", "V", [[2, 0], [2, 2]], None, None, None), line("ventana", "W", 0.5, -0.1, 1.5, -0.1, 0.2))
    t2t = views.transfer_to_transfer(cells, bounds).collect()
    assert any(r.u.startswith("VTN_") or r.v.startswith("VTN_") for r in t2t) and any("WINDOW" in r.u + r.v for r in t2t)
    assert views.door_to_door(cells, bounds).count() == 0
    assert bounds.where("role = 'general_transfer_contact_blocked' and not traversable").count() == 1


def test_split_space_keeps_doors_apart(spark):
    cells, bounds, _ = built(
        spark, space("A", sq(0, 0, 2)), space("B", sq(2, 0, 2)), ("frontera_virtual", "V", [[2, 0], [2, 2]], None, None, None),
        line("puerta_simple", "D1", -0.1, 0.5, -0.1, 1.5, 0.2), line("puerta_simple", "D2", 4.1, 0.5, 4.1, 1.5, 0.2),
    )
    assert views.door_to_door(cells, bounds).count() == 0
    assert all(sum("DOOR" in x for x in (r.u, r.v)) == 1 for r in views.transfer_to_transfer(cells, bounds).collect())


def test_wall_and_modes(spark):
    cells, bounds, _ = built(spark, space("A", sq(0, 0, 2, 3)), space("B", sq(2.2, 0, 2, 3)), line("muro_interior", "W", 2.1, 0, 2.1, 3), line("puerta_simple", "D", 2.1, 1, 2.1, 2, None, 0.9, "W"))
    check_sound(cells)
    assert cells.where("category = 'WallSegment'").count() == 2  # the door parts the wall
    assert set(views.room_adjacency(cells, bounds).first().kinds) == {"transfer", "wall"} and views.room_to_room(cells, bounds).count() == 1
    nodes, walk = builder.dual(cells, bounds)
    _, every = builder.dual(cells, bounds, "all_adjacency")
    assert nodes.count() == cells.count() and walk.where("not traversable").count() == 0 and every.count() > walk.count()
    with pytest.raises(ValueError):
        builder.dual(cells, bounds, "other")


def test_opening_rules(spark):
    cells, bounds, _ = built(spark, space("A", sq(0, 0, 2)), line("puerta_simple", "D", 2.1, 0.5, 2.1, 1.5, 0.2), line("ventana", "W", -5, 0, -5, 1, 0.2))
    assert {r.rule for r in dq.opening_faults(cells, bounds).collect()} == {"door without two spaces", "window without a space"}


def test_ramp_joins_rooms(spark):
    cells, bounds, _ = built(spark, space("A", sq(0, 0, 1)), space("B", sq(3, 0, 1)), ("ramp", "R", sq(1, 0, 2, 1), None, None, None))
    assert "connector" in views.room_to_room(cells, bounds).first().kinds
    links = builder.vertical_links(spark.createDataFrame([("S", 0, "L00", "a"), ("S", 1, "L01", "b"), ("S", 2, "L02", "c")], "connector string, level_order int, level string, cell string"))
    assert {(r.lower, r.upper) for r in links.collect()} == {("L00", "L01"), ("L01", "L02")}
    assert views.vertical_connectivity(cells, links, bounds)[1].where("kind = 'vertical'").count() == 2


def test_column_and_junctions(spark):
    rows = [space("A", sq(0, 0, 5)), ("object", "C", sq(2, 2, 1), None, None, None)]
    rows += [line("muro_exterior", f"W{i}", *p) for i, p in enumerate([(0, 0, 5, 0), (5, 0, 5, 5), (5, 5, 0, 5), (0, 5, 0, 0)])]
    cells, bounds, contacts = built(spark, *rows)
    check_sound(cells)
    assert cells.where("category = 'WallJunction'").count() == 4 and cells.where("category = 'Column'").count() == 1
    area = cells.where("navigation_type = 'GeneralSpace'").agg(F.sum("area")).first()[0]
    assert area == pytest.approx(4.8 * 4.8 - 1, abs=1e-6)
    exposed = {r.cell: r.exposed for r in builder.exposed_length(cells, contacts).collect()}
    assert exposed["CS_L00_OBJECT_001"] == pytest.approx(0, abs=1e-6)


def test_detection(spark):
    shell = [line("muro_exterior", f"W{i}", *p) for i, p in enumerate([(0, 0, 4, 0), (4, 0, 4, 3), (4, 3, 0, 3), (0, 3, 0, 0)])]
    one = builder.detected_spaces(frame(spark, *shell)).collect()
    assert [r.status for r in one] == ["ok"] and one[0].area == pytest.approx(3.8 * 2.8)
    two = builder.detected_spaces(frame(spark, *shell, line("muro_interior", "D", 2, 0, 2, 3))).collect()
    assert len(two) == 2
    had = spark.createDataFrame([(r.level, r.space, r.ring) for r in two], "level string, space string, ring array<array<double>>")
    again = builder.detected_spaces(frame(spark, *shell, line("muro_interior", "D", 2.1, 0, 2.1, 3)), had).collect()
    assert {r.space for r in again} == {r.space for r in two}
    kept = builder.detected_spaces(frame(spark, *shell[:3]), had).collect()
    assert {(r.space, r.status) for r in kept} == {(r.space, "open") for r in two}


def test_small_rules(spark):
    f = builder.source_features(frame(spark, space("b", sq(0, 0, 1)), space("a", sq(1, 0, 1)))).select("name", "feature").collect()
    assert {tuple(r) for r in f} == {("a", "SF_L00_SPACE_001"), ("b", "SF_L00_SPACE_002")}
    r = spark.range(1).select(builder.with_defaults(F.lit("Ramp"), F.create_map(F.lit("slope"), F.lit("0.1"))).alias("m"), builder.is_object(F.array(F.lit("Column"))).alias("o"), builder.is_transfer(F.lit("space"), F.lit("Puerta 1"), F.lit(None).cast("string")).alias("t")).first()
    assert r.m == {"slope": "0.1", "requiresSteps": "false", "wheelchairAccessible": "true"} and r.o and r.t
    snaps = spark.createDataFrame([(1, "a", "x", False), (2, "b", "y", False), (3, "a", None, True)], "version int, key string, value string, deleted boolean")
    assert {r.key for r in builder.history(snaps, 3).collect()} == {"b"} and builder.history(snaps, 2).count() == 2
