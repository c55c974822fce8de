import pytest
from pyspark.sql import functions as F

from evaquery.functions import geometry as G
from evaquery.functions import ids, scalars
from evaquery.operators import dq, filters
from evaquery.plans import builder, legacy
from evaquery.sources import documents

from .test_documents import MODEL, write

RECT = "name string, x0 double, y0 double, x1 double, y1 double"


def test_links(spark):
    rooms = spark.createDataFrame([("A", 0.0, 0.0, 4.0, 4.0), ("B", 4.2, 0.0, 8.0, 4.0), ("C", 20.0, 20.0, 24.0, 24.0)], RECT)
    doors = spark.createDataFrame([("D1", 4.0, 1.0, 4.2, 2.0), ("D2", 4.0, 3.0, 4.2, 3.9), ("far", 50.0, 50.0, 51.0, 51.0)], RECT)
    got = {(r.origen, r.destino, r.tipo, r.contexto) for r in legacy.links(rooms, doors).collect()}
    doors_ = {(a, d, "navegable_puerta", None) for a in "AB" for d in ("D1", "D2")}
    assert got == doors_ | {("D1", "D2", "door_to_door", a) for a in "AB"}
    near = legacy.links(rooms.withColumn("x0", F.when(F.col("name") == "B", 4.1).otherwise(F.col("x0"))), doors)
    assert near.where("tipo = 'adyacencia_fisica'").count() == 1
    spaces = spark.createDataFrame([("A", "NavigableSpace"), ("D1", "TransferSpace"), ("x", None)], "name string, klass string")
    assert {(r.nodo_id, r.capa_superior, r.capa_inferior) for r in legacy.layer_links(spaces).collect()} == {("A", "adyacencia_fisica", "navegable_puerta"), ("D1", "navegable_puerta", "door_to_door")}
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 99.0, 99.0)], "point int, x double, y double")
    assert {(r.point, r.room, r.inferred) for r in legacy.assigned(pts, rooms).collect()} == {(1, "A", False), (2, "A", True)}


def test_route_texts(spark):
    r = spark.createDataFrame([(["A", "D1", "D2", "X"], [None, "Hall", "D2"])], "p array<string>, c array<string>")
    e = r.select(legacy.expanded(F.col("p"), F.col("c")).alias("e")).select("e", scalars.path_text(F.col("e")).alias("t")).first()
    assert e.e == ["A", "D1", "Hall", "D2", "X"] and e.t == "A -> D1 -> Hall -> D2 -> X"
    assert spark.range(1).select(scalars.path_text(F.array(*map(F.lit, "aab"))).alias("t")).first().t == "a -> b"


def test_congestion_and_policies(spark):
    e = spark.createDataFrame([(1, 2, 5.0, 0.0, 0.0), (2, 3, 5.0, 50.0, 0.0)], "u int, v int, weight double, x double, y double")
    crowd = spark.createDataFrame([(1.0, 1.0), (2.0, 0.0), (9.0, 9.0)], "x double, y double")
    once = legacy.congested(e, crowd)
    assert {r.u: r.weight for r in legacy.congested(once, crowd).collect()} == {1: 13.0, 2: 5.0}
    hazard = spark.createDataFrame([(3, 0.5)], "node int, risk double")
    weigh = lambda p: {r.u: r.weight for r in legacy.runtime_graph([e.select("u", "v", "weight")], F.lit(True), hazard, p).collect()}
    assert weigh("shortest_path") == {1: 5.0, 2: 5.0} and weigh("dynamic_weighted") == {1: 5.0, 2: 12.5} and weigh("least_risk")[2] == pytest.approx(0.55)
    with pytest.raises(ValueError):
        weigh("other")
    beacons = spark.createDataFrame([("b1", 0.0, 0.0, 3.0, None), ("b2", 0.0, 0.0, 1.0, [9])], "beacon string, x double, y double, radius double, refs array<int>")
    cells = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0)], "cell int, x double, y double")
    assert {tuple(r) for r in legacy.beacon_cells(beacons, cells).collect()} == {("b1", 1), ("b2", 9)}


def test_cut_walls(spark):
    ring = lambda x0, y0, x1, y1: [[float(a), float(b)] for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    walls = spark.createDataFrame([("L", "W1", ring(0, 0, 10, 0.2)), ("L", "W2", ring(0, 5, 10, 5.2))], "level string, name string, ring array<array<double>>")
    holes = spark.createDataFrame([("L", ring(4, -0.1, 5, 0.3))], "level string, ring array<array<double>>")
    assert [(r.wall, r.fragment) for r in legacy.cut_walls(walls, holes).orderBy("wall", "fragment").collect()] == [("W1", 1), ("W1", 2), ("W2", 1)]


def test_model_faults(spark, tmp_path):
    broken = dict(MODEL, edges=[{"id": "E_1", "connects": ["L:D:N_A", "L:D:N_X"]}], nodes=[{"id": "N_A", "duality": "L:P:CS_Z"}])
    m = documents.models(spark, write(tmp_path / "b.json", broken))
    got = {(r.rule, r.key) for r in legacy.model_faults(documents.cells(m), documents.boundaries(m), documents.nodes(m), documents.edges(m)).collect()}
    assert got >= {("edge connects", "N_X"), ("node duality", "CS_Z"), ("node without point", "N_A"), ("cell without polygon", "CS_A")} and ("cell boundedBy", "CB_1") not in got


def test_frames(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 3, 1.0), (0, 2, 2.0), (2, 3, 2.0)], "u long, v long, weight double")
    times = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "t double")
    scores = times.crossJoin(spark.range(4).toDF("node")).withColumn("score", F.when((F.col("node") == 1) & (F.col("t") >= 1), 0.2).otherwise(1.0))
    asked = spark.createDataFrame([(0, 3)], "start long, goal long")
    got = {r.t: (r.cost, r.path, r.replan, r.overlap) for r in legacy.frames(times, edges, scores, asked).collect()}
    assert got[0.0] == (2.0, [0, 1, 3], True, None) and got[1.0] == (4.0, [0, 2, 3], True, 0.5) and got[2.0] == (4.0, [0, 2, 3], False, 1.0)


def test_scalars_and_ids(spark):
    one = lambda **c: spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    r = one(
        t=ids.token(F.lit("  Salón nº 1 ")), e=ids.token(F.lit("¡!")), p=ids.prefixed("SP", F.lit("sala é 2")), c=ids.compact_cell(F.lit("CS_L00_ROOM_001")), d=ids.display(F.lit("N_L00_X"), ["N_L00_", "N_"]),
        l=ids.level_code(F.lit("LEVEL_7")), m=ids.level_code(F.lit("mezzanine")), n=ids.node_of_cell(F.lit("CS_A")), b=ids.db_edge_of_boundary(F.lit("XX-1")),
    )
    assert r.asDict() == {"t": "SALON_N_1", "e": "ITEM", "p": "SP_SALA_É_2", "c": "ROOM_001", "d": "X", "l": "L07", "m": "MEZZANINE", "n": "N_A", "b": None}
    loco = lambda *v: F.array(*map(F.lit, v))
    r = one(a=scalars.locomotion_list(loco("step", "ROLLING", "x", "walking")), b=scalars.locomotion_list(F.lit(None).cast("array<string>")), c=scalars.shared_locomotion(loco("A", "B"), loco("B")), d=scalars.shared_locomotion(loco("A"), loco("B")), s=scalars.space_class(F.lit("Puerta 3"), F.lit(None).cast("string"), F.lit(None).cast("string"))["function"], w=scalars.space_class(F.lit("Aula"), F.lit(None).cast("string"), F.lit("LAB"))["category"])
    assert r.a == ["Walking", "Rolling"] and r.b == ["Walking", "Rolling"] and r.c == ["B"] and r.d == ["A", "B"] and r.s == "ConnectionSpace" and r.w == "lab"
    G_, N_, T_ = "GeneralSpace", "NonNavigableSpace", "TransferSpace"
    role = lambda a, b, blocked=False, wall=True: scalars.boundary_role(F.lit(a), F.lit(b), F.lit(blocked), F.lit(wall), F.lit(wall))
    r = one(a=role(G_, T_), b=role(T_, G_, True), c=role(G_, "ObjectSpace"), d=role(T_, N_), e=role(N_, N_), f=role(G_, G_), g=role(T_, "ObjectSpace"))
    assert list(r) == ["general_transfer_contact", "general_transfer_contact_blocked", "general_non_navigable_contact", "transfer_non_navigable_contact", "internal_wall_contact", None, None]
    r = one(x=scalars.turn_factor(F.lit(0.6)), s=scalars.event_span(F.lit(5.0), F.lit(3), 6.0, F.lit("ramp_hold"))["stop"], z=scalars.rounded6(F.lit(-1e-9)), t=scalars.crowd_tolerance(F.lit(9), F.lit(10)), v=scalars.profile_speed(F.lit("Elderly")))
    assert (r.x, r.s, r.t, r.v) == (0.85, 43.0, 0.3, 0.05) and str(r.z) == "0.0"


def test_geometry_columns(spark):
    one = lambda **c: spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    L = lambda x: F.lit(float(x))
    box = {"x0": L(0), "y0": L(0), "x1": L(4), "y1": L(2)}
    r = one(
        g=G.geojson("Point", F.slice(G.ring(box), 1, 1)), p=G.geojson("Polygon", G.ring(box)), w=G.ring_area(G.wall_ring(L(0), L(0), L(3), L(4), L(0.2))), i=G.in_ring(L(1), L(1), G.ring(box)), o=G.in_ring(L(5), L(1), G.ring(box)),
        x=G.segments_cross(L(0), L(0), L(2), L(2), L(0), L(2), L(2), L(0)), k=G.boundary_key(L(1), L(2), L(0), L(0)) == G.boundary_key(L(0), L(0), L(1), L(2)), z=G.resized(L(0), L(0), L(4), L(0), L(2)), s=G.side_of_box(L(4), L(1), box), j=G.junction_extension(L(0.2), L(0.01), L(0)), n=G.wall_ring(L(1), L(1), L(1), L(1), L(1)), q=G.snapped(L(0.12345)),
    )
    assert r.g == '{"type":"Point","coordinates":[0.0,0.0]}' and r.p.count("[") == 7
    assert abs(abs(r.w) - 1.0) < 1e-9 and r.i and not r.o and r.x and r.k and (r.z.ax, r.z.bx) == (1.0, 3.0) and r.s == "east" and r.j == 0.6 and r.n is None and abs(r.q - 0.123) < 1e-9


def test_quality_rules_and_predicates(spark):
    tiles = spark.createDataFrame([("a", 0, 1, 1), ("a", 1, 2, 1), ("b", 0, 0, 0), ("b", 1, 5, 0), ("c", 0, 1, 1), ("c", 1, 2, 1), ("c", 2, 1, 1)], "chain string, pos int, x int, y int")
    assert {(r.chain, r.fault) for r in dq.chain_faults(tiles).collect()} == {("b", "gap"), ("c", "repeated")}
    pt = lambda *ps: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ps])
    r = spark.range(1).select(dq.ring_faults(pt((0, 0), (1, 0), (1, 1), (0, 0))).alias("ok"), dq.ring_faults(pt((0, 0), (1, 0), (1, 1), (0, 1))).alias("open"), dq.ring_faults(pt((0, 0), (1, 0), (2, 0), (0, 0))).alias("flat")).first()
    assert (r.ok, r.open, r.flat) == (None, "open", "no area")
    c = spark.createDataFrame([("Door", None, "c1", "TransferSpace", "x"), ("Window", None, None, "TransferSpace", "x"), ("Stair", False, "s1", "TransferSpace", "x"), ("WallSegment", None, None, "NonNavigableSpace", "Wall")], "category string, default_traversable boolean, connector_id string, navigation_type string, function string")
    got = c.select(filters.transfer_is_open().alias("o"), filters.connector_id().alias("c"), filters.is_wall_cell().alias("w")).collect()
    assert [tuple(r) for r in got] == [(True, None, False), (False, None, False), (False, "s1", False), (False, None, True)]
    assert filters.in_layers(c, "transfer").count() == 3
    levels = spark.createDataFrame([("L1", 1), ("L0", 0)], "id string, `order` int")
    assert {(r.id, r.target) for r in builder.next_level(levels).collect()} == {("L0", "L1"), ("L1", "L1")}
    walls = spark.createDataFrame([("muro_exterior",), ("muro_interior",), ("ventana",)], "tipo string")
    assert tuple(filters.colliders(walls).first()) == (1, 1)
