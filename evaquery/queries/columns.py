"""Column rules of the inventory, over the driver's tables: names, classes, motion, masks, lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import ids, scalars
from ..operators import filters
from ..plans import builder, cep, legacy
from ..registry import query
from ..sources import domain, sinks
from ..sources.domain import sql, table

#: Part names with a word in front that tells what they are.
NAMED = "CASE p_size % 6 WHEN 0 THEN 'Puerta ' WHEN 1 THEN 'SALIDA ' WHEN 2 THEN 'frontera ' WHEN 3 THEN 'Ventana ' ELSE 'Sala ' END || p_name"


def named(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumn("name", F.expr(NAMED))


@query("f02_f07_f09_names", r"""SELECT p_partkey, 'SP_' || trim(regexp_replace(upper(trim(p_name)), '[^\p{L}\p{N}]+', '_', 'g'), '_') AS space, trim(upper(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g')), '_') AS compact,
    regexp_replace(CASE p_size % 3 WHEN 0 THEN 'CS_L00_' WHEN 1 THEN 'CB_' ELSE 'N_' END || p_name, '^(CS_L00_|CS_|CB_)', '') AS shown FROM part""")  # fmt: skip
def f02(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    name = F.col("p_name")
    marked = F.expr("CASE p_size % 3 WHEN 0 THEN 'CS_L00_' WHEN 1 THEN 'CB_' ELSE 'N_' END || p_name")
    cell = F.concat(F.when(F.col("p_size") % 2 == 0, "CS_L00_").otherwise("CS_"), name)
    return p.select("p_partkey", ids.prefixed("SP", name).alias("space"), ids.compact_cell(cell).alias("compact"), ids.display(marked, ["CS_L00_", "CS_", "CB_"]).alias("shown"))


@query("f11_f38_f41_f42_scales", sql("""SELECT u, v, round(10 + (40 - 10) * (weight / 17.0::DOUBLE), 6) AS ramp, round(1 + 4 * (17 - weight) / (17 -
    1 + 1e-9), 6) AS width, CASE WHEN coalesce(score, 1.0) < 0.6 THEN 'grey' ELSE 'graded' END AS shade,
    CASE WHEN weight * 150 > 2000 THEN 'red' WHEN weight * 150 > 20 THEN 'yellow' ELSE 'cyan' END AS colour FROM edges JOIN nodes ON u = node""", "edges", "nodes"))
def f11(spark: SparkSession, d: str) -> DataFrame:
    e = domain.edges(spark, d).join(domain.nodes(spark, d).select(F.col("node").alias("u"), "score"), "u")
    w = F.col("weight")
    return e.select("u", "v", F.round(scalars.lerp(F.lit(10), F.lit(40), w / 17), 6).alias("ramp"), F.round(scalars.inverse_width(w, F.lit(1), F.lit(17)), 6).alias("width"), scalars.score_class(F.col("score"), 0.6).alias("shade"), scalars.weight_class(w * 150).alias("colour"))


LOCOMOTIONS = "CASE p_size % 5 WHEN 0 THEN [' Step', 'WALKING'] WHEN 1 THEN ['Rolling', 'flying', 'rolling '] WHEN 2 THEN ['none'] WHEN 3 THEN ['Unspecified', 'stairs'] END"


@query("f13_locomotion_lists", f"""SELECT p_partkey, CASE WHEN len(own) = 0 THEN ['Rolling', 'Walking'] ELSE own END AS allowed FROM (SELECT p_partkey, list_sort(list_distinct(list_filter(list_transform(coalesce({LOCOMOTIONS}, []),
    lambda v: CASE lower(trim(v)) WHEN 'flying' THEN 'Flying' WHEN 'rolling' THEN 'Rolling' WHEN 'walking' THEN 'Walking' WHEN 'unspecified' THEN 'Unspecified' WHEN 'step' THEN 'Walking' WHEN 'stairs' THEN 'Walking' END), lambda v: v IS NOT NULL))) AS own FROM part)""")  # fmt: skip
def f13(spark: SparkSession, d: str) -> DataFrame:
    given = F.expr(LOCOMOTIONS.replace("[", "array(").replace("]", ")"))
    return table(spark, d, "part").select("p_partkey", F.array_sort(scalars.locomotion_list(given)).alias("allowed"))


@query("f14_space_classes", f"""WITH n AS (SELECT p_partkey, lower({NAMED}) AS low, CASE p_size % 4 WHEN 0 THEN 'TransferSpace' WHEN 1 THEN 'AnchorSpace' END AS klass, CASE WHEN p_size % 7 = 0 THEN 'DOOR' WHEN p_size % 7 = 1 THEN 'Hall' END AS category, coalesce(lower(CASE WHEN p_size % 7 = 0 THEN 'DOOR' WHEN p_size % 7 = 1 THEN 'Hall' END), '') AS own FROM part)
    SELECT p_partkey, CASE WHEN low LIKE '%salida%' THEN 'exit_space' WHEN low LIKE '%frontera%' OR low LIKE '%puerta%' OR own = 'door' OR klass = 'TransferSpace' THEN 'transfer_space' WHEN klass = 'AnchorSpace' THEN 'exit_space' ELSE 'navigable_space' END AS type,
    CASE WHEN low LIKE '%salida%' THEN 'exit' WHEN low LIKE '%frontera%' THEN 'virtual_boundary' WHEN low LIKE '%puerta%' OR own = 'door' THEN 'door_space' WHEN klass = 'TransferSpace' THEN coalesce(nullif(own, ''), 'transfer_space') WHEN klass = 'AnchorSpace' THEN 'exit' ELSE coalesce(nullif(own, ''), 'room') END AS category,
    CASE WHEN low LIKE '%salida%' THEN 'ExitSpace' WHEN low LIKE '%frontera%' THEN 'VirtualBoundary' WHEN low LIKE '%puerta%' OR own = 'door' OR klass = 'TransferSpace' THEN 'ConnectionSpace' WHEN klass = 'AnchorSpace' THEN 'ExitSpace' ELSE 'General' END AS function FROM n""")  # fmt: skip
def f14(spark: SparkSession, d: str) -> DataFrame:
    klass = F.when(F.col("p_size") % 4 == 0, "TransferSpace").when(F.col("p_size") % 4 == 1, "AnchorSpace")
    category = F.when(F.col("p_size") % 7 == 0, "DOOR").when(F.col("p_size") % 7 == 1, "Hall")
    return named(spark, d).select("p_partkey", scalars.space_class(F.col("name"), klass, category).alias("c")).select("p_partkey", "c.type", "c.category", "c.function")


@query("f15_connection_names", f"""WITH n AS (SELECT p_partkey, {NAMED} AS name FROM part), t AS (SELECT p_partkey, name, CASE WHEN lower(name) LIKE '%salida%' THEN 'exit_space' WHEN lower(name) LIKE '%frontera%' THEN 'virtual_boundary' WHEN lower(name) LIKE '%puerta%' THEN 'door_space' ELSE 'space' END AS type FROM n)
    SELECT a.p_partkey AS a, b.p_partkey AS b, a.type AS node_type, CASE WHEN a.type = 'exit_space' OR b.type = 'exit_space' THEN 'emergency_exit' WHEN a.type = 'virtual_boundary' OR b.type = 'virtual_boundary' THEN 'virtual_boundary' ELSE 'door_passage' END AS connector,
    CASE WHEN a.type <> 'space' THEN a.name WHEN b.type <> 'space' THEN b.name END AS through FROM t a JOIN t b ON b.p_partkey = a.p_partkey + 1""")  # fmt: skip
def f15(spark: SparkSession, d: str) -> DataFrame:
    n = named(spark, d)
    a, b = n.select(F.col("p_partkey").alias("a"), F.col("name").alias("na")), n.select(F.col("p_partkey").alias("b"), F.col("name").alias("nb"))
    na, nb = F.col("na"), F.col("nb")
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", scalars.node_type(na).alias("node_type"), scalars.connector_type(na, nb).alias("connector"), scalars.through_space(na, nb).alias("through"))


@query("f17_f20_f21_speeds", sql("""SELECT u, v, round(0.1 * CASE u % 3 WHEN 0 THEN 1.2 WHEN 1 THEN 0.5 ELSE 1.0 END, 6) AS speed, round(weight /
    1.2::DOUBLE * (1 + 0.6 * greatest(0, v - 3) / 3), 6) AS time, greatest(1.0, round(weight / 0.6::DOUBLE, 2)) AS capacity FROM edges""", "edges"))
def f17(spark: SparkSession, d: str) -> DataFrame:
    profile = F.when(F.col("u") % 3 == 0, "Rolling").when(F.col("u") % 3 == 1, "Elderly").otherwise("Adult")
    return domain.edges(spark, d).select("u", "v", F.round(scalars.profile_speed(profile), 6).alias("speed"), F.round(scalars.congested_time(F.col("weight"), F.col("v")), 6).alias("time"), scalars.edge_capacity(F.col("weight")).alias("capacity"))


ROOMS = """m AS (SELECT room, avg(value) FILTER (WHERE variable = 'view') * 80 AS co2, avg(value) FILTER (WHERE variable = 'click') * 30 AS tvoc, avg(value) FILTER (WHERE variable = 'purchase') AS temp, avg(value) FILTER (WHERE variable = 'error') AS hum,
 max(value) AS iaq, max(value) - min(value) AS jump FROM readings GROUP BY room HAVING co2 IS NOT NULL AND tvoc IS NOT NULL AND temp IS NOT NULL AND hum IS NOT NULL),
s AS (SELECT *, CASE WHEN co2 > 5000 THEN 3 WHEN co2 > 2000 THEN 2 WHEN co2 >= 1000 THEN 1 ELSE 0 END AS sc, CASE WHEN tvoc > 3000 THEN 3 WHEN tvoc > 1000 THEN 2 WHEN tvoc >= 500 THEN 1 ELSE 0 END AS sv,
 least(3, CASE WHEN temp >= 60 THEN 3 WHEN temp >= 50 THEN 2 ELSE 0 END + CASE WHEN temp > 30 AND hum > 70 THEN 1 ELSE 0 END) AS st, CASE WHEN iaq > 150 THEN 2 WHEN iaq > 100 THEN 1 ELSE 0 END AS si, CASE WHEN abs(jump) > 5 THEN 2 ELSE 0 END AS sp FROM m),
e AS (SELECT *, st >= 2 AND (sv >= 1 OR si >= 1) AS fire, sv >= 2 AND (sc >= 1 OR sp = 2) AS leak, sp = 2 AND st >= 1 AS shock FROM s)"""


@query("f24_t15_room_evaluations", sql(f""", {ROOMS} SELECT room, fire, leak, shock, temp > 40 AND hum > 80 AS heat, (['green', 'yellow', 'orange', 'red'])[CASE WHEN fire OR leak OR shock THEN 3 ELSE greatest(sc, sv, st, si, sp) END + 1] AS state,
    array_to_string(list_filter([CASE WHEN fire THEN 'fire' END, CASE WHEN leak THEN 'leak' END, CASE WHEN shock THEN 'shock' END, CASE WHEN sc >= 1 THEN 'co2' END, CASE WHEN sv >= 1 THEN 'tvoc' END, CASE WHEN st >= 1 THEN 'temp' END, CASE WHEN si >= 1 THEN 'iaq' END, CASE WHEN sp >= 1 THEN 'pres' END], lambda x: x IS NOT NULL), ',') AS reasons,
    least(CASE WHEN co2 > 10000 THEN 2.0 WHEN co2 > 5000 THEN 3.0 END, CASE WHEN iaq > 150 THEN 5.0 WHEN iaq > 100 THEN 20.0 END, CASE WHEN tvoc > 3000 THEN 2.0 WHEN tvoc > 1000 THEN 5.0 WHEN tvoc >= 500 THEN 10.0 END, CASE WHEN temp > 70 THEN 0.5 WHEN temp >= 60 THEN 1.0 WHEN temp >= 50 THEN 3.0 END)::DOUBLE AS minutes FROM e""", "readings"))  # fmt: skip
def f24(spark: SparkSession, d: str) -> DataFrame:
    """Rooms that have all four kinds of readings."""
    mean = lambda v, k: F.avg(F.when(F.col("variable") == v, F.col("value"))) * k
    m = domain.readings(spark, d).groupBy("room").agg(mean("view", 80).alias("co2"), mean("click", 30).alias("tvoc"), mean("purchase", 1).alias("temp"), mean("error", 1).alias("hum"), F.max("value").alias("iaq"), (F.max("value") - F.min("value")).alias("jump"))
    s = cep.room_states(m.where("co2 is not null and tvoc is not null and temp is not null and hum is not null"))
    return s.select("room", "fire", "leak", "shock", cep.extreme_heat(F.col("temp"), F.col("hum")).alias("heat"), "state", F.array_join("reasons", ",").alias("reasons"), F.col("t_max").alias("minutes"))


@query("f26_f27_f28_motion_rules", sql("""SELECT u, v, CASE WHEN weight % 4 IN (0, 1) THEN 0.25 WHEN weight % 4 = 2 THEN 1.0 ELSE 1.2 END AS radius,
    CASE WHEN (u - v) / 10.0 < 0 THEN CASE WHEN (v - u) % 3 = 0 THEN 0.3 ELSE CASE WHEN (v - u) % 3 = 1 THEN 0.6 ELSE 1.0 END END END AS turn,
    round(least(4 * exp(-8 * weight / 40.0::DOUBLE), 6.0), 6) AS wall, round(least(1.5 * exp(-weight / 10.0::DOUBLE), 6.0), 6) AS social FROM edges""", "edges"))
def f26(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("weight")
    kind = F.get(F.array(*map(F.lit, ("door", "exit", "virtual", "room"))), w % 4)
    dot = F.get(F.array(F.lit(-0.5), F.lit(0.2), F.lit(0.9)), ((F.col("v") - F.col("u")) % 3).cast("int"))
    return domain.edges(spark, d).select("u", "v", scalars.arrival_radius(kind).alias("radius"), scalars.turn_factor(dot).alias("turn"), F.round(scalars.wall_force(w / 40), 6).alias("wall"), F.round(scalars.social_force(w / 10), 6).alias("social"))


@query("f29_velocities", sql(""", f AS (SELECT u, v, 0.7::DOUBLE * (u - 10) + 0.3::DOUBLE * weight AS x, 0.7::DOUBLE * (v - 15) - 0.3::DOUBLE *
    weight AS y FROM edges) SELECT u, v, round(x * CASE WHEN sqrt(x * x + y * y) > 5 THEN 5 / sqrt(x * x + y * y) ELSE 1 END, 6) AS x, round(y *
    CASE WHEN sqrt(x * x + y * y) > 5 THEN 5 / sqrt(x * x + y * y) ELSE 1 END, 6) AS y FROM f""", "edges"))
def f29(spark: SparkSession, d: str) -> DataFrame:
    made = scalars.velocity(F.col("u") - 10, F.col("v") - 15, F.col("weight"), -F.col("weight"), F.lit(5.0))
    return domain.edges(spark, d).select("u", "v", made.alias("w")).select("u", "v", F.round("w.x", 6).alias("x"), F.round("w.y", 6).alias("y"))


@query("f30_utc_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def f30(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", scalars.utc_text(F.col("ts")).alias("at"))


@query("f32_tolerances", sql("SELECT node, round(0.5 + 0.2 * (node % 4), 6) AS dynamic, round(greatest(0.3, 1 - node / 20.0::DOUBLE), 6) AS crowd FROM nodes", "nodes"))
def f32(spark: SparkSession, d: str) -> DataFrame:
    return domain.nodes(spark, d).select("node", F.round(scalars.dynamic_tolerance(0.5, 0.2, F.col("node") % 4), 6).alias("dynamic"), F.round(scalars.crowd_tolerance(F.col("node"), F.lit(20.0)), 6).alias("crowd"))


KINDS = "(['GeneralSpace', 'TransferSpace', 'NonNavigableSpace', 'ObjectSpace'])"


@query("f33_f34_border_roles", sql(f""", t AS (SELECT u, v, {KINDS}[u % 4 + 1] AS a, {KINDS}[v % 4 + 1] AS b, weight % 2 = 0 AS wall, weight % 3 = 0 AS blocked FROM edges), p AS (SELECT *, [a, b] AS ab FROM t)
    SELECT u, v, CASE WHEN list_contains(ab, 'GeneralSpace') AND list_contains(ab, 'TransferSpace') THEN CASE WHEN blocked THEN 'general_transfer_contact_blocked' ELSE 'general_transfer_contact' END
    WHEN list_contains(ab, 'GeneralSpace') AND (list_contains(ab, 'NonNavigableSpace') OR list_contains(ab, 'ObjectSpace')) THEN 'general_non_navigable_contact' WHEN list_contains(ab, 'TransferSpace') AND list_contains(ab, 'NonNavigableSpace') THEN 'transfer_non_navigable_contact'
    WHEN a = 'NonNavigableSpace' AND b = 'NonNavigableSpace' AND wall THEN 'internal_wall_contact' END AS role,
    CASE WHEN a = 'TransferSpace' AND wall THEN 'exterior_anchor' WHEN a = 'NonNavigableSpace' AND NOT wall AND blocked THEN 'outer_shell' END AS exterior FROM p""", "edges"))  # fmt: skip
def f33(spark: SparkSession, d: str) -> DataFrame:
    kind = lambda end: F.get(F.array(*map(F.lit, ("GeneralSpace", "TransferSpace", "NonNavigableSpace", "ObjectSpace"))), (F.col(end) % 4).cast("int"))
    wall, blocked = F.col("weight") % 2 == 0, F.col("weight") % 3 == 0
    outer = scalars.exterior_role(kind("u"), F.when(wall, "AnchorSpace").otherwise("Wall"), F.when(blocked, F.array(F.lit("muro_exterior"))).otherwise(F.array(F.lit("muro_interior"))))
    return domain.edges(spark, d).select("u", "v", scalars.boundary_role(kind("u"), kind("v"), blocked, wall, wall).alias("role"), outer.alias("exterior"))


@query("f36_f43_defaults", sql("""SELECT DISTINCT category, CASE category WHEN 'Window' THEN 'defaultTraversable=false,scenarioControllable=true,sillHeightM=1.2,windowType=fixed' WHEN 'Door' THEN 'defaultTraversable=true,sillHeightM=1.2' WHEN 'Stair' THEN 'requiresSteps=true,sillHeightM=1.2,wheelchairAccessible=false'
    WHEN 'Ramp' THEN 'requiresSteps=false,sillHeightM=1.2,slope=0.08,wheelchairAccessible=true' ELSE 'sillHeightM=1.2' END AS attributes, CASE WHEN category IN ('Elevator', 'Ramp') THEN 'Walking,Rolling' ELSE 'Walking' END AS locomotion FROM plan""", "plan"))  # fmt: skip
def f36(spark: SparkSession, d: str) -> DataFrame:
    given = F.create_map(F.lit("sillHeightM"), F.lit("1.2"))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries(builder.with_defaults(F.col("category"), given)), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return domain.plan(spark, d).select("category", listed.alias("attributes"), F.array_join(builder.connector_locomotion(F.col("category")), ",").alias("locomotion")).distinct()


@query("f43_next_levels", "SELECT r_name AS id, coalesce(lead(r_name) OVER (ORDER BY r_regionkey % 2, r_name), r_name) AS target FROM region")
def f43(spark: SparkSession, d: str) -> DataFrame:
    return builder.next_level(table(spark, d, "region").select(F.col("r_name").alias("id"), (F.col("r_regionkey") % 2).alias("order")))


@query("f39_f40_route_texts", sql("""SELECT u, v, 'N' || u || CASE WHEN u <> v THEN ' -> N' || v ELSE '' END || CASE WHEN v <> weight THEN ' -> N' || weight ELSE '' END AS path,
    'N' || u || CASE WHEN u + 1 <> v THEN ' -> N' || (u + 1) ELSE '' END || ' -> N' || v || CASE WHEN v <> 7 AND weight <> 7 THEN ' -> N7' ELSE '' END || ' -> N' || weight AS rooms FROM edges""", "edges"))  # fmt: skip
def f39(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.concat(F.lit("N"), c.cast("string"))
    path = F.array(n(F.col("u")), n(F.col("v")), n(F.col("weight")))
    return domain.edges(spark, d).select("u", "v", scalars.path_text(path).alias("path"), F.array_join(legacy.expanded(path, F.array(n(F.col("u") + 1), F.lit("N7"))), " -> ").alias("rooms"))


@query("f44_event_spans", sql("""SELECT node, 5.0 + node AS start, 5.0 + node + (node % 4) * 6.0 +
    CASE WHEN node % 2 = 0 THEN 25.0 ELSE 26.0 END AS stop FROM nodes""", "nodes"))
def f44(spark: SparkSession, d: str) -> DataFrame:
    span = scalars.event_span(5.0 + F.col("node"), F.col("node") % 4 + 1, 6.0, F.when(F.col("node") % 2 == 0, "triangle").otherwise("ramp_hold"))
    return domain.nodes(spark, d).select("node", span.alias("s")).select("node", "s.start", "s.stop")


@query("p03_general_always_walks", sql("SELECT node FROM nodes WHERE locomotion IN ('WALK') OR (locomotion IS NULL AND kind = 'GENERAL')", "nodes"))
def p03(spark: SparkSession, d: str) -> DataFrame:
    return domain.nodes(spark, d).where(filters.mobility_allowed(("WALK",), general_without=True)).select("node")


@query("x08_profile_masks", sql("""SELECT 'GENERAL' AS profile, node FROM nodes WHERE (coalesce(locomotion IN ('WALK', 'RAMP'), false) OR (locomotion
    IS NULL AND kind = 'GENERAL')) AND coalesce(score, 1.0) >= 0.6 UNION ALL SELECT 'PMR', node FROM nodes
    WHERE coalesce(locomotion IN ('RAMP'), false) AND coalesce(score, 1.0) >= 0.75""", "nodes"))
def x08(spark: SparkSession, d: str) -> DataFrame:
    n, out = domain.nodes(spark, d), None
    for name, (least, allowed, general) in scalars.PROFILES.items():
        own = n.where(filters.mobility_allowed(allowed, general) & filters.safe(least)).select(F.lit(name).alias("profile"), "node")
        out = own if out is None else out.unionByName(own)
    return out


@query("p13_p18_type_predicates", f"""WITH n AS (SELECT p_partkey, p_size, {NAMED} AS name, (['puerta_simple', 'ventana', 'muro_interior', 'stair', 'frontera_virtual', 'room'])[p_size % 6 + 1] AS kind, (['Door', 'Exit', 'Stair', 'Window', 'WallSegment', 'Room'])[p_size % 6 + 1] AS category FROM part)
    SELECT p_partkey, kind IN ('puerta_simple', 'puerta_doble', 'salida', 'ventana', 'ventana_practicable') AS opening, kind IN ('puerta_simple', 'ventana', 'stair', 'frontera_virtual') OR lower(name) SIMILAR TO '.*(puerta|salida|ventana|window|frontera).*' OR p_size % 5 = 0 AS transfer, p_size % 3 = 0 AS object,
    p_size % 4 <> 0 AND category IN ('Door', 'Exit', 'Stair') AS passable, CASE WHEN category = 'Stair' THEN 'C' || p_partkey END AS connector, category = 'WallSegment' AND p_size % 2 = 0 AS wall FROM n""")  # fmt: skip
def p13(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda *values: F.get(F.array(*map(F.lit, values)), (F.col("p_size") % 6).cast("int"))
    n = named(spark, d).withColumn("kind", pick("puerta_simple", "ventana", "muro_interior", "stair", "frontera_virtual", "room")).withColumn("category", pick("Door", "Exit", "Stair", "Window", "WallSegment", "Room"))
    n = n.withColumn("default_traversable", F.when(F.col("p_size") % 4 == 0, False)).withColumn("connector_id", F.concat(F.lit("C"), F.col("p_partkey").cast("string")))
    n = n.withColumn("navigation_type", F.when(F.col("category") == "WallSegment", "NonNavigableSpace").otherwise("GeneralSpace")).withColumn("function", F.when(F.col("p_size") % 2 == 0, "Wall").otherwise("Other"))
    marked = F.array(F.when(F.col("p_size") % 3 == 0, "Column").otherwise("Space"), F.lit("x"))
    return n.select("p_partkey", builder.is_opening(F.col("kind")).alias("opening"), builder.is_transfer(F.col("kind"), F.col("name"), F.when(F.col("p_size") % 5 == 0, "AnchorSpace")).alias("transfer"), builder.is_object(marked).alias("object"), filters.transfer_is_open().alias("passable"), filters.connector_id().alias("connector"), filters.is_wall_cell().alias("wall"))


@query("p21_view_presets", """SELECT * FROM (VALUES ('basic', 2, NULL), ('spaces', 4, NULL), ('navigable-boundaries', 3, NULL), ('non-navigable', 2,
    NULL), ('overlaps', 4, NULL), ('graph-base-dual', 4, 'base_dual'), ('graph-space-adjacency', 2, 'space_adjacency'), ('graph-space-connectivity',
    3, 'space_connectivity'), ('graph-room-adjacency', 3, 'room_adjacency'), ('graph-room-to-room', 2, 'room_to_room_accessibility'),
    ('graph-room-transfer', 3, 'space_connectivity'), ('graph-transfer-to-transfer', 4, 'transfer_to_transfer'), ('graph-door-to-door', 2,
    'door_to_door'), ('graph-vertical', 1, 'vertical_connectivity'), ('graph-multilevel-vertical', 2, 'vertical_connectivity')) t(preset, layers,
    view)""")
def p21(spark: SparkSession, d: str) -> DataFrame:
    rows = [(name, len(layers), view) for name in filters.PRESETS for layers, view in [filters.preset(name)]]
    return spark.createDataFrame(rows, "preset string, layers int, view string")


@query("p23_rolling_layer", sql("SELECT node, kind FROM nodes WHERE locomotion IN ('RAMP', 'ELEVATOR') OR locomotion = 'WALK'", "nodes"))
def p23(spark: SparkSession, d: str) -> DataFrame:
    return domain.nodes(spark, d).where(filters.mobility_allowed(("RAMP", "ELEVATOR", "WALK"), general_without=False)).select("node", "kind")


@query("p26_colliders", "SELECT count(*) FILTER (WHERE p_size % 5 = 0) AS exterior, count(*) FILTER (WHERE p_size % 5 IN (1, 2)) AS interior FROM part")
def p26(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 5 == 0, "muro_exterior").when(F.col("p_size") % 5 <= 2, "muro_interior").otherwise("puerta_simple")
    return filters.colliders(table(spark, d, "part").select(kind.alias("tipo")))


@query("g01_g23_g24_lines", sql("""SELECT e.u, e.v, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS length, (a.x + b.x) / 2.0 AS mx, (a.y +
    b.y) / 2.0 AS my, [a.x, a.y, b.x, b.y] AS line FROM edges e JOIN nodes a ON u = a.node JOIN nodes b ON v = b.node""", "edges", "nodes"))
def g01(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("u", "v", F.round(G.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")), 6).alias("length"), ((F.col("ax") + F.col("bx")) / 2.0).alias("mx"), ((F.col("ay") + F.col("by")) / 2.0).alias("my"), F.array("ax", "ay", "bx", "by").alias("line"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Edges with the places of their ends."""
    n = domain.nodes(spark, d)
    at = lambda k, p: n.select(F.col("node").alias(k), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    return domain.edges(spark, d).join(at("u", "a"), "u").join(at("v", "b"), "v")


LINES = 'ln AS (SELECT u, v, weight, a.x::DOUBLE AS ax, a.y::DOUBLE AS ay, b.x::DOUBLE AS bx, b.y::DOUBLE AS "by", sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS len FROM edges JOIN nodes a ON u = a.node JOIN nodes b ON v = b.node)'


@query("g02_g48_wall_rings", sql(f', {LINES} SELECT u, v, list_transform([ax - ("by" - ay) / len * 0.2, ay + (bx - ax) / len * 0.2, bx - ("by" - ay) / len * 0.2, "by" + (bx - ax) / len * 0.2, bx + ("by" - ay) / len * 0.2, "by" - (bx - ax) / len * 0.2, ax + ("by" - ay) / len * 0.2, ay - (bx - ax) / len * 0.2], lambda c: round(c, 6) + 0.0) AS ring, round(len * 0.4, 6) AS area FROM ln', "edges", "nodes"))
def g02(spark: SparkSession, d: str) -> DataFrame:
    ring = G.wall_ring(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.lit(0.4))
    flat = F.flatten(F.transform(F.slice("r", 1, 4), lambda p: F.array(F.round(p["x"], 6) + 0.0, F.round(p["y"], 6) + 0.0)))
    return lines(spark, d).withColumn("r", ring).select("u", "v", flat.alias("ring"), F.round(F.abs(G.ring_area(F.col("r"))), 6).alias("area"))


@query("g08_g47_segments", sql("""SELECT cell, i, CAST(round(CASE i WHEN 0 THEN x1 - x0 WHEN 1 THEN y1 - y0 WHEN 2 THEN x1 - x0 ELSE y1 - y0 END, 6) AS DOUBLE) AS length, CASE i WHEN 0 THEN 1.0 WHEN 2 THEN -1.0 ELSE 0.0 END::DOUBLE AS dx, CASE i WHEN 1 THEN 1.0 WHEN 3 THEN -1.0 ELSE 0.0 END::DOUBLE AS dy FROM cells, range(0, 4) r(i)""", "cells"))
def g08(spark: SparkSession, d: str) -> DataFrame:
    """The sides of every cell's ring, with unit vectors; sides of no length left out."""
    r = domain.cells(spark, d).withColumn("ring", G.ring(G.rect()))
    side = r.select("cell", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("ring") - 2), lambda i: F.struct(F.get("ring", i).alias("a"), F.get("ring", i + 1).alias("b")))).alias("i", "s"))
    own = side.select("cell", F.col("i").cast("bigint").alias("i"), (F.col("s.b.x") - F.col("s.a.x")).alias("dx"), (F.col("s.b.y") - F.col("s.a.y")).alias("dy")).withColumn("length", F.hypot("dx", "dy")).where("length > 1e-6")
    return own.select("cell", "i", F.round("length", 6).alias("length"), (F.col("dx") / F.col("length")).alias("dx"), (F.col("dy") / F.col("length")).alias("dy"))


@query("g13_g42_centres", sql("""SELECT cell, (x0 + x1) / 2.0 AS x, (y0 + y1) / 2.0 AS y,
    CASE cell % 4 WHEN 0 THEN 'south' WHEN 1 THEN 'east' WHEN 2 THEN 'north' ELSE 'west' END AS side FROM cells""", "cells"))
def g13(spark: SparkSession, d: str) -> DataFrame:
    r = G.rect()
    mid = G.vertex_mean(G.ring(r))
    k = F.col("cell") % 4
    px = F.when(k == 1, r["x1"]).when(k == 3, r["x0"]).otherwise((r["x0"] + r["x1"]) / 2.0)
    py = F.when(k == 0, r["y0"]).when(k == 2, r["y1"]).otherwise((r["y0"] + r["y1"]) / 2.0)
    return domain.cells(spark, d).withColumn("m", mid).select("cell", "m.x", "m.y", G.side_of_box(px, py, r).alias("side"))


@query("g15_lines_of_sight", sql(f""", {LINES}, cr AS (SELECT a.u, a.v, count(*) AS n FROM ln a JOIN ln b ON (a.u, a.v) <> (b.u, b.v) WHERE a.u IN (0, 1) AND b.u IN (10, 11)
    AND sign((a.bx - a.ax) * (b.ay - a.ay) - (a."by" - a.ay) * (b.ax - a.ax)) * sign((a.bx - a.ax) * (b."by" - a.ay) - (a."by" - a.ay) * (b.bx - a.ax)) < 0
    AND sign((b.bx - b.ax) * (a.ay - b.ay) - (b."by" - b.ay) * (a.ax - b.ax)) * sign((b.bx - b.ax) * (a."by" - b.ay) - (b."by" - b.ay) * (a.bx - b.ax)) < 0 GROUP BY 1, 2)
    SELECT l.u, l.v, coalesce(n, 0) AS blocked FROM ln l LEFT JOIN cr USING (u, v) WHERE l.u IN (0, 1) AND len <= 30""", "edges", "nodes"))  # fmt: skip
def g15(spark: SparkSession, d: str) -> DataFrame:
    """Ways of at most 30 metres from two nodes, and how many of the walls between others they cross."""
    ln = lines(spark, d)
    sight = ln.where("u in (0, 1)").where(G.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= 30).select("u", "v", "ax", "ay", "bx", "by")
    walls = ln.where("u in (10, 11)").select(F.col("u").alias("wu"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
    met = G.segments_cross(*[F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")])
    hits = sight.join(walls, met).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))
    return sight.join(hits, ["u", "v"], "left").select("u", "v", F.coalesce("n", F.lit(0)).alias("blocked"))


@query("g26_g46_j14_nearest_walls", sql("""SELECT cell, wall, d FROM (SELECT cell, w AS wall, round(CASE w WHEN 'west' THEN mx WHEN 'south' THEN my ELSE sqrt((mx - greatest(0, least(500, mx))) ** 2 + (my - 1000) ** 2) END, 6)::DOUBLE AS d, row_number() OVER (PARTITION BY cell ORDER BY CASE w WHEN 'west' THEN mx WHEN 'south' THEN my ELSE sqrt((mx - greatest(0, least(500, mx))) ** 2 + (my - 1000) ** 2) END, w) AS rk
    FROM (SELECT cell, (x0 + x1) / 2.0 AS mx, (y0 + y1) / 2.0 AS my FROM cells), (VALUES ('west'), ('south'), ('north')) t(w)) WHERE rk = 1 AND d <= 60""", "cells"))  # fmt: skip
def g26(spark: SparkSession, d: str) -> DataFrame:
    """The wall nearest to each cell's middle, of three, where it is no further than 60."""
    mx, my = (F.col("x0") + F.col("x1")) / 2.0, (F.col("y0") + F.col("y1")) / 2.0
    walls = {"west": (0, -9e9, 0, 9e9), "south": (-9e9, 0, 9e9, 0), "north": (0, 1000, 500, 1000)}
    far = lambda a: mx if a == "west" else my if a == "south" else G.on_segment(mx, my, *[F.lit(float(x)) for x in walls[a]])["d"]
    best = F.array_min(F.array(*[F.struct(far(w).cast("double").alias("d"), F.lit(w).alias("wall")) for w in walls]))
    return domain.cells(spark, d).select("cell", best.alias("b")).where("b.d <= 60").select("cell", "b.wall", F.round("b.d", 6).alias("d"))


@query("g35_g44_openings", sql(f', {LINES} SELECT u, v, round(least(0.3 / (2 * (0.1 + u / 30.0)) + 0.1 + 0.002, 0.6), 6) AS extension, round((ax + bx) / 2 - (bx - ax) / 2 / len * 1.2, 6) + 0.0 AS ax, round((ay + "by") / 2 - ("by" - ay) / 2 / len * 1.2, 6) + 0.0 AS ay, round((ax + bx) / 2 + (bx - ax) / 2 / len * 1.2, 6) + 0.0 AS bx, round((ay + "by") / 2 + ("by" - ay) / 2 / len * 1.2, 6) + 0.0 AS "by" FROM ln', "edges", "nodes"))
def g35(spark: SparkSession, d: str) -> DataFrame:
    cut = G.resized(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.lit(1.2))
    made = lines(spark, d).select("u", "v", F.round(G.junction_extension(F.lit(0.3), 0.1 + F.col("u") / 30.0, F.lit(0.1)), 6).alias("extension"), cut.alias("c"))
    return made.select("u", "v", "extension", *[(F.round(f"c.{c}", 6) + 0.0).alias(c) for c in ("ax", "ay", "bx", "by")])


@query("s24_g49_geojson", sql("""SELECT cell, '{"type":"Point","coordinates":[' || (x0 / 4.0) || ',' || (y0 / 4.0) || ']}' AS point, '{"type":"Polygon","coordinates":[[[' || x0 || '.0,' || y0 || '.0],[' || x1 || '.0,' || y0 || '.0],[' || x1 || '.0,' || y1 || '.0],[' || x0 || '.0,' || y1 || '.0],[' || x0 || '.0,' || y0 || '.0]]]}' AS polygon FROM cells""", "cells"))
def s24(spark: SparkSession, d: str) -> DataFrame:
    point = F.array(F.struct((F.col("x0") / 4.0).alias("x"), (F.col("y0") / 4.0).alias("y")))
    return domain.cells(spark, d).select("cell", G.geojson("Point", point).alias("point"), G.geojson("Polygon", G.ring(G.rect())).alias("polygon"))


@query("s23_line_protocol", sql("""SELECT event_id, 'lectura,room=' || room || ',variable=' || replace(variable, ' ', '\\ ') || ' value=' ||
    CAST(event_id % 100 AS VARCHAR) || ' ' || CAST(epoch_us(ts) AS VARCHAR) || '000' AS line FROM readings""", "readings"))
def s23(spark: SparkSession, d: str) -> DataFrame:
    r = domain.readings(spark, d)
    return r.select("event_id", sinks.line_protocol(F.lit("lectura"), F.col("room").cast("string"), F.col("variable"), F.col("event_id") % 100, F.col("ts").cast("timestamp")).alias("line"))


@query("g16_g19_box_measures", sql("""SELECT a.cell AS a, b.cell AS b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS both, a.w * a.h + b.w * b.h - 2 * greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS either
    FROM cells a JOIN cells b ON a.level = b.level AND a.cell < b.cell AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1""", "cells"))  # fmt: skip
def g16(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a level whose boxes meet: the area they share and the area only one of them has."""
    from ..operators.joins import box_pairs

    a, b = G.rect("a_"), G.rect("b_")
    both = G.overlap_area(a, b)
    return box_pairs(domain.cells(spark, d).select("cell", "level", "x0", "y0", "x1", "y1"), "cell", ["level"], 64).select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b"), both.alias("both"), (G.area(a) + G.area(b) - 2 * both).alias("either"))


@query("g27_inflated_rooms", sql("SELECT cell, round((w + 0.3) * (h + 0.3), 6) AS area, round(least(x1 + 0.15, x0 + 5.0) - (x0 - 0.15), 6) AS cut FROM cells", "cells"))
def g27(spark: SparkSession, d: str) -> DataFrame:
    """Rooms drawn out by 0.15, and how much of them lies west of a line five in."""
    wide = G.inflated(G.rect(), 0.15)
    return domain.cells(spark, d).select("cell", F.round(G.area(wide), 6).alias("area"), F.round(G.overlap_length(wide["x0"], wide["x1"], F.lit(-1e9), F.col("x0") + 5.0), 6).alias("cut"))


@query("g21_snapped_lines", sql(f""", {LINES} SELECT u, v, round(round((ax / 7.0) / 0.001) * 0.001, 6) AS x, round(round((ay / 3.0) / 0.001) * 0.001,
    6) AS y FROM ln""", "edges", "nodes"))
def g21(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("u", "v", F.round(G.snapped(F.col("ax") / 7.0), 6).alias("x"), F.round(G.snapped(F.col("ay") / 3.0), 6).alias("y"))
