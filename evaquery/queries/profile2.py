"""The newer map document over the floor plan: a model a row of fifty rooms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates
from ..plans import profile2
from ..registry import query
from ..sources import domain
from ..sources.domain import sql
from .relations import TOUCH, model

#: Names that tell rooms, doors and exits apart, and the links between them, in the order of both ends' names.
NAMED = f"""{TOUCH}, sp AS (SELECT 'B' || (cell // 3 // 50) AS model, name AS raw, CASE category WHEN 'Room' THEN 'Sala ' WHEN 'Exit' THEN 'Salida ' ELSE 'Puerta ' END || name AS name, 'SPACE_' || CASE category WHEN 'Room' THEN 'SALA_' WHEN 'Exit' THEN 'SALIDA_' ELSE 'PUERTA_' END || name AS id, category, (x0 + x1) / 2.0 AS x, (y0 + y1) / 2.0 AS y, cell FROM plan WHERE category IN ('Room', 'Door', 'Exit')),
lk AS (SELECT a.model, a.name AS origen, b.name AS destino, a.id AS ida, b.id AS idb, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS yb, b.category, row_number() OVER (PARTITION BY a.model ORDER BY a.name, b.name) AS index FROM touch JOIN sp a ON a.raw = room JOIN sp b ON b.raw = via WHERE a.model = b.model)"""


def frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spaces, links, spawn points)."""
    cells, bounds = model(spark, d)
    word = F.when(F.col("category") == "Room", "Sala ").when(F.col("category") == "Exit", "Salida ").otherwise("Puerta ")
    own = cells.where("category in ('Room', 'Door', 'Exit')").join(domain.plan(spark, d).select(F.col("name").alias("cell"), F.col("cell").alias("k")).hint("merge"), "cell")
    own = own.withColumn("model", F.concat(F.lit("B"), F.floor(F.floor(F.col("k") / 3) / 50).cast("string"))).withColumn("name", F.concat(word, "cell"))
    loco = F.when(F.col("category") == "Room", F.array(F.lit("Walking"), F.lit("Rolling"), F.lit("Walking"))).when(F.col("k") % 2 == 0, F.array(F.lit("Rolling"))).otherwise(F.array(F.lit("Step")))
    spaces = own.select("model", "name", "cell", "x", "y", "ring", F.lit(None).cast("string").alias("klass"), F.lit(None).cast("string").alias("category"), loco.alias("locomotion"))
    side = lambda c, n, m: spaces.select(F.col("cell").alias(c), F.col("name").alias(n), F.col("model").alias(m))
    ends = bounds.select(F.col("a").alias("p"), F.col("b").alias("q")).unionByName(bounds.select(F.col("b").alias("p"), F.col("a").alias("q")))
    links = ends.join(side("p", "origen", "model").hint("merge"), "p").join(side("q", "destino", "other").hint("merge"), "q").where("model = other and origen like 'Sala%' and destino not like 'Sala%'")
    index = F.row_number().over(Window.partitionBy("model").orderBy("origen", "destino"))
    links = links.select("model", index.alias("index"), "origen", "destino", F.lit("navegable_puerta").alias("tipo"), F.lit(None).cast("string").alias("contexto"))
    rooms = own.where("category = 'Room' and k % 5 = 0")
    n = F.row_number().over(Window.partitionBy("model").orderBy("k"))
    points = rooms.select("model", n.alias("index"), F.when(F.col("k") % 2 == 0, F.col("x")).otherwise(-500.0).alias("x"), "y")
    return spaces.drop("cell"), links, points


@query("b23_v2_spaces", sql(f""", {NAMED} SELECT model, id AS space_id, CASE category WHEN 'Room' THEN 'navigable_space' WHEN 'Exit' THEN 'exit_space'
    ELSE 'transfer_space' END AS space_type, CASE category WHEN 'Room' THEN 'General' WHEN 'Exit' THEN 'ExitSpace' ELSE 'ConnectionSpace' END AS
    function, CASE WHEN category = 'Room' THEN 'walking,rolling' WHEN cell % 2 = 0 THEN 'rolling' ELSE 'step' END AS locomotion FROM sp""", "plan"))
def b23(spark: SparkSession, d: str) -> DataFrame:
    return profile2.spaces(frames(spark, d)[0]).select("model", "space_id", "space_type", "function", F.array_join("locomotion", ",").alias("locomotion"))


@query("b23_v2_boundaries", sql(f""", {NAMED} SELECT model, 'BOUNDARY_NAV_' || CASE WHEN index < 1000 THEN lpad(CAST(index AS VARCHAR), 3, '0') ELSE
    CAST(index AS VARCHAR) END AS boundary_id, ida AS source_space_id, idb AS target_space_id, 'navigable_boundary' AS boundary_type,
    CASE WHEN destino LIKE '%EAST%' THEN 2.0 ELSE 3.0 END::DOUBLE AS length, false AS approximate FROM lk""", "plan"))
def b23_boundaries(spark: SparkSession, d: str) -> DataFrame:
    own, links, _ = frames(spark, d)
    part = lambda i: F.get("line", F.lit(i))
    made = profile2.boundaries(links, profile2.spaces(own))
    return made.select("model", "boundary_id", "source_space_id", "target_space_id", "boundary_type", F.round(F.hypot(part(2) - part(0), part(3) - part(1)), 6).alias("length"), "approximate")


@query("b23_b25_v2_graph", sql(f""", {NAMED}, e AS (SELECT *, CASE WHEN category = 'Exit' THEN 'emergency_exit' ELSE 'door_passage' END AS kind FROM lk) SELECT model, 'E_CONN_' || CASE WHEN index < 1000 THEN lpad(CAST(index AS VARCHAR), 3, '0') ELSE CAST(index AS VARCHAR) END AS edge_id, 'N_CONN_' || substr(ida, 7) AS source_node_id, 'N_CONN_' || substr(idb, 7) AS target_node_id,
    round(sqrt((ax - bx) ** 2 + (ay - yb) ** 2), 6) AS distance_m, kind AS connector_type, CASE WHEN kind = 'emergency_exit' THEN 'pedestrian,emergency_exit' ELSE 'pedestrian' END AS flows, idb AS through_space_id FROM e""", "plan"))  # fmt: skip
def b23_graph(spark: SparkSession, d: str) -> DataFrame:
    own, links, _ = frames(spark, d)
    made = profile2.graph_edges(links, profile2.spaces(own))
    return made.select("model", "edge_id", "source_node_id", "target_node_id", F.round("distance_m", 6).alias("distance_m"), "connector_type", F.array_join("allowed_flows", ",").alias("flows"), "through_space_id")


@query("b23_v2_spawns", sql(f""", {NAMED}, p AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY cell) AS n FROM sp
    WHERE category = 'Room' AND cell % 5 = 0) SELECT model, 'SPAWN_' || lpad(CAST(n AS VARCHAR), 3, '0') AS spawn_id,
    CASE WHEN cell % 2 = 0 THEN id ELSE (SELECT min(s.id) FROM sp s WHERE s.model = p.model) END AS space_ref, cell % 2 <> 0 AS inferred FROM p""", "plan"))
def b23_spawns(spark: SparkSession, d: str) -> DataFrame:
    own, _, points = frames(spark, d)
    return profile2.spawns(points, profile2.spaces(own)).select("model", "spawn_id", "space_ref", "inferred")


@query("s20_v2_documents", sql(f""", {NAMED} SELECT m.model, (SELECT count(*) FROM sp WHERE sp.model = m.model) AS spaces, coalesce((SELECT count(*)
    FROM lk WHERE lk.model = m.model), 0) AS edges, coalesce((SELECT count(DISTINCT x) FROM (SELECT model, unnest([ida, idb]) AS x FROM lk) z
    WHERE z.model = m.model), 0) AS nodes FROM (SELECT DISTINCT model FROM sp) m""", "plan"))
def s20(spark: SparkSession, d: str) -> DataFrame:
    """The documents as text, parsed again: how many members each has."""
    made = profile2.document(*frames(spark, d))
    parsed = made.select("model", F.from_json("value", "spaces array<struct<space_id:string>>, graph_edges array<struct<edge_id:string>>, graph_nodes array<struct<node_id:string>>").alias("v"))
    counts = aggregates.sizes(parsed.select("model", "v.*"), spaces="spaces", edges="graph_edges", nodes="graph_nodes")
    return counts.select("model", "spaces", "edges", "nodes")
