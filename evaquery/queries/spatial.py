"""Identifiers, scalars, geometry, spatial joins, topology and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import geometry as G
from ..functions import ids, scalars
from ..operators import dq, joins
from ..plans import topology
from ..registry import query
from ..sources import domain
from ..sources.domain import sql, table

OVER = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
LEN = """CASE WHEN a.x1 = b.x0 OR b.x1 = a.x0 THEN greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) WHEN a.y1 = b.y0 OR b.y1 = a.y0 THEN greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) ELSE 0 END"""
PAIR = "FROM cells a JOIN cells b ON a.level = b.level AND a.cell < b.cell"
CONTACT = f"""contact AS (SELECT a.cell AS a, b.cell AS b, a.level, greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1,
    least(a.y1, b.y1) AS y1, {LEN} AS length {PAIR} WHERE {OVER} = 0 AND {LEN} > 0)"""
KEY = "md5(concat_ws('|', x0, y0, x1, y1))"
BOUNDS = f"""bounds AS (SELECT k AS boundary_key, level, m.a AS a, m.b AS b, m.length AS length
    FROM (SELECT {KEY} AS k, level, min({{'a': a, 'b': b, 'length': length}}) AS m FROM contact GROUP BY 1, 2))"""


@query("f01_tokens", "SELECT p_partkey, trim(upper(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g')), '_') AS token FROM part")
def f01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", ids.token(F.col("p_name")).alias("token"))


@query("f03_references", "SELECT c_custkey, 'L' || c_nationkey || ':' || c_mktsegment || ':' || c_name AS ref, c_name AS tail FROM customer")
def f03(spark: SparkSession, d: str) -> DataFrame:
    ref = ids.reference(F.concat(F.lit("L"), F.col("c_nationkey").cast("string")), F.col("c_mktsegment"), F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", ref.alias("ref")).select("c_custkey", "ref", ids.tail(F.col("ref")).alias("tail"))


@query("f04_f05_derived_ids", sql("""SELECT cell_id, 'N_' || replace(upper(cell_id), '-', '_') AS node, 'ND-' || substr(cell_id, 4) AS db_node, 'EG-'
    || substr(cell_id, 4) AS db_edge FROM cells""", "cells"))
def f04(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("cell_id")
    return domain.cells(spark, d).select(c, ids.node_of_cell(c).alias("node"), ids.db_node_of_cell(c).alias("db_node"), ids.db_edge_of_boundary(F.regexp_replace(c, "^CS-", "CB-")).alias("db_edge"))


@query("f06_f08_padded_ids", """SELECT p_partkey, 'CB-' || CASE WHEN length(CAST(p_partkey AS VARCHAR)) >= 4 THEN CAST(p_partkey AS VARCHAR) ELSE
    lpad(CAST(p_partkey AS VARCHAR), 4, '0') END AS boundary, 'L' || CASE WHEN p_size < 10 THEN '0' ELSE '' END || p_size AS level_code FROM part""")
def f06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", ids.numbered("CB-", F.col("p_partkey"), 4).alias("boundary"), ids.level_code(F.concat(F.lit("LEVEL_"), F.col("p_size").cast("string"))).alias("level_code"))


@query("f12_window_scores", sql(""", w AS (SELECT node, t, kind3, node * 1.0::DOUBLE AS start, 20.0::DOUBLE AS dur FROM (SELECT node, (['hold','ramp','triangle','other'])[node % 4 + 1] AS kind3 FROM nodes), (SELECT unnest([0, 5, 10, 15, 20, 25, 30]) AS t))
    SELECT node, CAST(t AS DOUBLE) AS t, round(CASE WHEN t < start OR t > start + dur THEN NULL WHEN kind3 = 'hold' THEN 0.4 WHEN kind3 = 'ramp' THEN 1 + (0.4 - 1) * ((t - start) / dur)
    WHEN kind3 = 'triangle' THEN CASE WHEN (t - start) / dur <= 0.5 THEN 1 + (0.4 - 1) * ((t - start) / dur * 2) ELSE 0.4 + (1 - 0.4) * ((t - start) / dur * 2 - 1) END END, 6) AS score FROM w""", "nodes"))  # fmt: skip
def f12(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["hold", "ramp", "triangle", "other"])), (F.col("node") % 4 + 1).cast("int"))
    w = domain.nodes(spark, d).select("node", kind.alias("kind3"), F.col("node").cast("double").alias("start"), F.explode(F.sequence(F.lit(0.0).cast("int"), F.lit(30), F.lit(5))).alias("k")).withColumn("t", F.col("k").cast("double"))
    return w.select("node", "t", F.round(scalars.window_score(F.col("kind3"), F.col("t"), F.col("start"), F.lit(20.0), F.lit(0.4), F.lit(1.0)), 6).alias("score"))


@query("f16_f22_edge_rules", sql("""SELECT u, v, round(weight * 0.8, 6) AS door, round(weight * 1.5, 6) AS room, greatest(1.0, round(weight / 0.6, 2)) AS capacity,
    round(weight / 1.2 * (1 + 0.6 * greatest(0, v - 3) / 3), 6) AS congested, CASE WHEN weight > 10 THEN 'yellow' ELSE 'cyan' END AS colour, round(1 + 4 * (17 - weight) / (17 - 1 + 1e-9), 6) AS width FROM edges""", "edges"))  # fmt: skip
def f16(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("weight")
    return domain.edges(spark, d).select(
        "u", "v", F.round(scalars.legacy_weight(w, F.lit("door_to_door")), 6).alias("door"), F.round(scalars.legacy_weight(w, F.lit("room_door")), 6).alias("room"), scalars.edge_capacity(w).alias("capacity"),
        F.round(scalars.congested_time(w, F.col("v")), 6).alias("congested"), scalars.weight_class(w * 2).alias("colour"), F.round(scalars.inverse_width(w, F.lit(1), F.lit(17)), 6).alias("width"),
    )


@query("f18_f19_risk_costs", sql(""", s AS (SELECT node, coalesce(score, 1.0) AS s FROM nodes)
    SELECT u, v, round(weight * (1 + 2.0 * greatest(1 - a.s, 1 - b.s)), 6) AS risk_weight, round(weight * 2.0 * greatest(1 - a.s, 1 - b.s), 6) AS
    penalty FROM edges JOIN s a ON u = a.node JOIN s b ON v = b.node""", "nodes", "edges"))
def f18(spark: SparkSession, d: str) -> DataFrame:
    s = domain.nodes(spark, d).select("node", F.coalesce("score", F.lit(1.0)).alias("s"))
    e = domain.edges(spark, d).join(s.select(F.col("node").alias("u"), F.col("s").alias("su")), "u").join(s.select(F.col("node").alias("v"), F.col("s").alias("sv")), "v")
    w, risk = scalars.risk_weight(F.col("weight"), F.col("su"), F.col("sv")), F.greatest(1 - F.col("su"), 1 - F.col("sv"))
    return e.select("u", "v", F.round(w, 6).alias("risk_weight"), F.round(w - scalars.cost_base(w, risk), 6).alias("penalty"))


@query("g12_cell_measures", sql("""SELECT cell_id, CAST(w * h AS DOUBLE) AS area, CAST(2 * (w + h) AS DOUBLE) AS perimeter, round(x0 + w / 2.0, 6) AS
    cx, round(y0 + h / 2.0, 6) AS cy, round(x0 + w / 2.0, 6) AS mx FROM cells""", "cells"))
def g12(spark: SparkSession, d: str) -> DataFrame:
    c = domain.cells(spark, d).select("cell_id", G.ring(G.rect()).alias("ring"))
    centre, mean = G.ring_centroid(F.col("ring")), G.vertex_mean(F.col("ring"))
    return c.select("cell_id", F.abs(G.ring_area(F.col("ring"))).alias("area"), G.ring_length(F.col("ring")).alias("perimeter"), F.round(centre["x"], 6).alias("cx"), F.round(centre["y"], 6).alias("cy"), F.round(mean["x"], 6).alias("mx"))


@query("g14_points_in_cells", sql("""SELECT c.cell_id, n.node FROM cells c JOIN nodes n ON n.x * 7.3 + 0.05 > c.x0 AND n.x * 7.3 + 0.05 < c.x1 AND
    n.y * 7.3 + 0.05 > c.y0 AND n.y * 7.3 + 0.05 < c.y1""", "cells", "nodes"))
def g14(spark: SparkSession, d: str) -> DataFrame:
    c = joins.tiles(domain.cells(spark, d).select("cell_id", "x0", "y0", "x1", "y1"), topology.TILE, G.rect()).withColumn("ring", G.ring(G.rect()))
    p = domain.nodes(spark, d).select("node", (F.col("x") * 7.3 + 0.05).alias("px"), (F.col("y") * 7.3 + 0.05).alias("py"))
    p = p.withColumn("tx", F.floor(F.col("px") / topology.TILE)).withColumn("ty", F.floor(F.col("py") / topology.TILE))
    return c.join(p, ["tx", "ty"]).where(G.in_ring(F.col("px"), F.col("py"), F.col("ring"))).select("cell_id", "node")


@query("g20_iou", sql(f"SELECT a.cell AS a, b.cell AS b, round({OVER} / (1.0 * a.w * a.h + b.w * b.h - {OVER}), 6) AS iou {PAIR} WHERE {OVER} > 0", "cells"))
def g20(spark: SparkSession, d: str) -> DataFrame:
    p = joins.box_pairs(domain.cells(spark, d).select("cell", "level", "x0", "y0", "x1", "y1"), "cell", ["level"], topology.TILE)
    a, b = G.rect("a_"), G.rect("b_")
    return p.where(G.overlap_area(a, b) > 0).select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b"), F.round(G.iou(a, b), 6).alias("iou"))


@query("g25_projection", sql("""SELECT u, v, round(least(greatest((a.x * 0 + 12.0 - a.x) * (b.x - a.x) + (17.0 - a.y) * (b.y - a.y), 0) / nullif((b.x
    - a.x) ** 2 + (b.y - a.y) ** 2, 0), 1), 6) AS t FROM edges JOIN nodes a ON u = a.node JOIN nodes b ON v = b.node""", "nodes", "edges"))
def g25(spark: SparkSession, d: str) -> DataFrame:
    n = domain.nodes(spark, d)
    e = domain.edges(spark, d).join(n.select(F.col("node").alias("u"), F.col("x").alias("ax"), F.col("y").alias("ay")), "u").join(n.select(F.col("node").alias("v"), F.col("x").alias("bx"), F.col("y").alias("by")), "v")
    at = G.on_segment(F.lit(12.0), F.lit(17.0), *[F.col(c).cast("double") for c in ("ax", "ay", "bx", "by")])
    return e.select("u", "v", F.round(at["t"], 6).alias("t"))


@query("j06_q01_cell_overlaps", sql(f"SELECT a.cell AS a, b.cell AS b, {OVER} AS area {PAIR} WHERE {OVER} > 0", "cells"))
def j06(spark: SparkSession, d: str) -> DataFrame:
    return topology.overlaps(domain.cells(spark, d))


@query("g18_cell_contacts", sql(f", {CONTACT} SELECT a, b, level, x0, y0, x1, y1, length FROM contact", "cells"))
def g18(spark: SparkSession, d: str) -> DataFrame:
    return topology.contacts(domain.cells(spark, d))


@query("j08_door_in_room", sql("""SELECT r.cell AS room, t.cell AS door FROM cells r JOIN cells t ON r.level = t.level AND r.kind = 'GENERAL' AND t.kind = 'TRANSFER'
    WHERE greatest(0, least(r.x1 + 0.15, t.x1) - greatest(r.x0 - 0.15, t.x0)) * greatest(0, least(r.y1 + 0.15, t.y1) - greatest(r.y0 - 0.15, t.y0)) > 0.03 * t.w * t.h""", "cells"))  # fmt: skip
def j08(spark: SparkSession, d: str) -> DataFrame:
    p = joins.box_pairs(domain.cells(spark, d).select("cell", "level", "kind", *[v.cast("double").alias(k) for k, v in G.inflated(G.rect(), 0.15).items()]), "cell", ["level"], topology.TILE)
    both = p.select(*p.columns).where("a_kind <> b_kind")
    room = lambda c: F.when(F.col("a_kind") == "GENERAL", F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    door = lambda c: F.when(F.col("a_kind") == "GENERAL", F.col(f"b_{c}")).otherwise(F.col(f"a_{c}"))
    r, t = {k: room(k) for k in ("x0", "y0", "x1", "y1")}, G.inflated({k: door(k) for k in ("x0", "y0", "x1", "y1")}, -0.15)
    return both.where(G.overlap_area(r, t) > 0.03 * G.area(t)).select(room("cell").alias("room"), door("cell").alias("door"))


@query("j15_cells_near_fires", sql("""SELECT c.cell, f.cell AS fire FROM cells c JOIN cells f ON f.is_exit
    WHERE sqrt((c.x0 - f.x0) ** 2 + (c.y0 - f.y0) ** 2) <= 35.0""", "cells"))
def j15(spark: SparkSession, d: str) -> DataFrame:
    c = domain.cells(spark, d).select("cell", F.col("x0").alias("x"), F.col("y0").alias("y"), "is_exit")
    return joins.within(c.drop("is_exit"), c.where("is_exit").drop("is_exit"), 35.0).select(F.col("p_cell").alias("cell"), F.col("t_cell").alias("fire"))


@query("b15_boundaries", sql(f", {CONTACT}, {BOUNDS} SELECT boundary_key, level, a, b, length FROM bounds", "cells"))
def b15(spark: SparkSession, d: str) -> DataFrame:
    return topology.boundaries(domain.cells(spark, d))


@query("b15_rebuild_actions", sql(f""", {CONTACT}, {BOUNDS} SELECT DISTINCT boundary_key,
    CASE WHEN a % 5 = 0 THEN 'insert' WHEN a % 7 = 0 THEN 'delete' ELSE 'keep' END AS action FROM bounds WHERE NOT (a % 5 = 0 AND a % 7 = 0)""", "cells"))
def b15r(spark: SparkSession, d: str) -> DataFrame:
    b = topology.boundaries(domain.cells(spark, d)).where("not (a % 5 = 0 and a % 7 = 0)")
    return topology.rebuilt(b.where("a % 5 <> 0").select("boundary_key").distinct(), b.where("a % 7 <> 0").select("boundary_key").distinct()).distinct()


@query("b16_nodes", sql("SELECT 'ND-' || lpad(CAST(cell AS VARCHAR), 6, '0') AS node_id, cell, (x0 + x1) / 2.0 AS x, (y0 + y1) / 2.0 AS y FROM cells", "cells"))
def b16(spark: SparkSession, d: str) -> DataFrame:
    return topology.node_rows(domain.cells(spark, d))


@query("b17_a01_edges", sql(f""", {CONTACT}, {BOUNDS} SELECT boundary_key AS boundary, a AS u, b AS v, round(sqrt(((p.x0 + p.x1) / 2.0 - (q.x0 + q.x1)
    / 2.0) ** 2 + ((p.y0 + p.y1) / 2.0 - (q.y0 + q.y1) / 2.0) ** 2), 6) AS weight FROM bounds o JOIN cells p ON p.cell = o.a
    JOIN cells q ON q.cell = o.b WHERE (SELECT count(*) FROM bounds z WHERE z.boundary_key = o.boundary_key) = 1""", "cells"))
def b17(spark: SparkSession, d: str) -> DataFrame:
    c = domain.cells(spark, d)
    return topology.edge_rows(topology.membership(topology.boundaries(c)), topology.node_rows(c))


@query("q_rules_report", sql(""", e AS (SELECT * FROM edges) SELECT 'Q-03 id format' AS rule, cell_id AS key FROM cells WHERE NOT regexp_matches(cell_id, '^CS-[0-9]{3,}$')
    UNION ALL SELECT 'Q-04 loop', CAST(u AS VARCHAR) FROM e WHERE u = v UNION ALL SELECT 'Q-05 pair', u || '|' || v FROM e GROUP BY u, v HAVING count(*) > 1
    UNION ALL SELECT DISTINCT 'Q-06 customer nation', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    UNION ALL SELECT 'Q-09 locomotion', cell_id FROM cells WHERE kind = 'TRANSFER' AND cell % 11 = 0""", "cells", "edges"))  # fmt: skip
def q_rules(spark: SparkSession, d: str) -> DataFrame:
    c, e = domain.cells(spark, d), domain.edges(spark, d)
    return dq.report([
        dq.breach(c, "Q-03 id format", "cell_id", ~F.col("cell_id").rlike("^CS-[0-9]{3,}$")), dq.breach(e, "Q-04 loop", "u", F.col("u") == F.col("v")), dq.repeated(e, "Q-05 pair", "u", "v"),
        dq.dangling(table(spark, d, "orders"), "Q-06 customer nation", "o_custkey", table(spark, d, "customer").where("c_acctbal > 0"), "c_custkey"),
        dq.breach(c.withColumn("locomotion", F.when(F.col("cell") % 11 != 0, F.coalesce("locomotion", F.lit("-")))), "Q-09 locomotion", "cell_id", (F.col("kind") == "TRANSFER") & F.col("locomotion").isNull()),
    ])


@query("q08_navigation_coherence", sql("""SELECT cell_id, f.kind, CASE WHEN f.kind = 'TRANSFER' THEN coalesce(c.locomotion, f.loc) END AS locomotion,
    f.kind IS NULL AS unknown_code FROM cells c LEFT JOIN (VALUES """ + ", ".join(map(str, schemas.NAVIGATION_FUNCTIONS)) + ") f(code, label, kind, loc) ON c.function_code = f.code", "cells"))
def q08(spark: SparkSession, d: str) -> DataFrame:
    return dq.coherent_navigation(domain.cells(spark, d), schemas.navigation_functions(spark))
