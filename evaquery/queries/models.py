"""Graph views, builder plans and runs over the cells of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.scalars import boundary_role
from ..plans import builder, graph, sim, topology, views
from ..registry import query
from ..sources import domain
from ..sources.domain import sql
from .spatial import CONTACT

CATEGORY = {"DOOR": "Door", "WINDOW": "Window", "STAIRS": "Stair", "RAMP": "Ramp", "ELEVATOR": "Elevator", "ESCALATOR": "Stair", "LOBBY": "Exit"}


def model(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(cells, boundaries) as the views take them: contacts of the rectangular cells, those of two general cells virtual by a third.

    Both are joined by shuffle, as the floor plan's are: what a part makes is larger than the file of parts.
    """
    c = domain.cells(spark, d).hint("merge")
    category = F.coalesce(F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv])[F.col("function_code")], F.lit("Room"))
    r = G.rect()
    ring = F.array(*[F.array(x.cast("double"), y.cast("double")) for x, y in ((r["x0"], r["y0"]), (r["x1"], r["y0"]), (r["x1"], r["y1"]), (r["x0"], r["y1"]))])
    cells = c.select(
        F.col("cell_id").alias("cell"), F.col("level").cast("string").alias("level"), F.when(F.col("kind") == "TRANSFER", "TransferSpace").otherwise("GeneralSpace").alias("navigation_type"),
        category.alias("category"), (F.col("function_code") != "WINDOW").alias("traversable"), ((r["x0"] + r["x1"]) / 2).alias("x"), ((r["y0"] + r["y1"]) / 2).alias("y"), ring.alias("ring"), F.col("cell").alias("k"),
    )
    side = lambda p: cells.select(F.col("k").alias(f"k{p}"), F.col("cell").alias(p), F.col("navigation_type").alias(f"t{p}"), F.col("traversable").alias(f"p{p}"))
    met = topology.contacts(c).select(F.col("a").alias("ka"), F.col("b").alias("kb"), F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), F.col("y1").alias("by"))
    both = met.join(side("a"), "ka").join(side("b"), "kb")
    soft = (F.col("ta") == "GeneralSpace") & (F.col("tb") == "GeneralSpace") & ((F.col("ka") + F.col("kb")) % 3 == 0)
    blocked = F.when(F.col("ta") == "TransferSpace", ~F.col("pa")).when(F.col("tb") == "TransferSpace", ~F.col("pb"))
    role = F.when(soft, "virtual").otherwise(F.coalesce(boundary_role(F.col("ta"), F.col("tb"), blocked, F.lit(False), F.lit(False)), F.lit("other")))
    bounds = both.select(F.concat_ws("-", F.lit("B"), F.col("ka").cast("string"), F.col("kb").cast("string")).alias("boundary"), "a", "b", soft.alias("is_virtual"), role.alias("role"), (F.coalesce(~blocked, F.lit(True))).alias("traversable"), *[F.col(x).cast("double").alias(x) for x in ("ax", "ay", "bx", "by")])
    return cells.drop("k"), bounds


MODEL = f"""{CONTACT}, cc AS (SELECT cell AS k, cell_id AS cell, kind, function_code <> 'WINDOW' AS open FROM cells),
mb AS (SELECT 'B-' || c.a || '-' || c.b AS boundary, x.cell AS a, y.cell AS b, x.kind AS ka, y.kind AS kb, x.open AS oa, y.open AS ob, x.kind = 'GENERAL' AND y.kind = 'GENERAL' AND (c.a + c.b) % 3 = 0 AS soft FROM contact c JOIN cc x ON c.a = x.k JOIN cc y ON c.b = y.k)"""
VIA = """via AS (SELECT a AS via, b AS cell, oa AS open FROM mb WHERE ka = 'TRANSFER' AND kb = 'GENERAL' UNION SELECT b, a, ob FROM mb
    WHERE kb = 'TRANSFER' AND ka = 'GENERAL')"""
FOUND = """found AS (SELECT a AS u, b AS v, boundary, CASE WHEN soft THEN 'virtual' ELSE 'direct' END AS kind, true AS t FROM mb
    WHERE ka = 'GENERAL' AND kb = 'GENERAL' UNION ALL SELECT p.cell, q.cell, p.via, 'transfer', p.open FROM via p
    JOIN via q ON p.via = q.via AND p.cell < q.cell)"""


@query("v01_base_dual", sql(f", {MODEL} SELECT boundary, a AS u, b AS v FROM mb", "cells"))
def v01(spark: SparkSession, d: str) -> DataFrame:
    return views.base_dual(*model(spark, d))[1].select("boundary", "u", "v")


@query("v02_space_adjacency", sql(f""", {MODEL}, {VIA}, {FOUND} SELECT u, v, list_sort(list_distinct(list(boundary))) AS boundaries,
    list_sort(list_distinct(list(kind))) AS kinds, bool_or(t) AS traversable, 'SAG_' ||
    CASE WHEN row_number() OVER (ORDER BY u, v) < 1000 THEN lpad(CAST(row_number() OVER (ORDER BY u, v) AS VARCHAR), 3, '0') ELSE CAST(row_number()
    OVER (ORDER BY u, v) AS VARCHAR) END AS edge FROM found GROUP BY u, v""", "cells"))
def v02(spark: SparkSession, d: str) -> DataFrame:
    return views.space_adjacency(*model(spark, d))


@query("v03_rooms", sql(f""", {MODEL}, bi AS (SELECT a AS u, b AS v FROM mb WHERE soft UNION SELECT b, a FROM mb
    WHERE soft), r(cell, root) AS (SELECT cell, cell FROM cc WHERE kind = 'GENERAL' UNION SELECT bi.v, r.root FROM r JOIN bi ON r.cell = bi.u)
    SELECT cell, min(root) AS room FROM r GROUP BY cell""", "cells", recursive=True))
def v03(spark: SparkSession, d: str) -> DataFrame:
    return views.rooms(*model(spark, d)).select("cell", "room")


@query("v03_room_adjacency")
def v03a(spark: SparkSession, d: str) -> DataFrame:
    return views.room_adjacency(*model(spark, d))


@query("v04_room_to_room")
def v04(spark: SparkSession, d: str) -> DataFrame:
    return views.room_to_room(*model(spark, d))


@query("v05_space_connectivity", sql(f""", {MODEL} SELECT boundary, a AS u, 'VTN_' || boundary AS v FROM mb WHERE soft UNION ALL
    SELECT boundary, b, 'VTN_' || boundary FROM mb WHERE soft UNION ALL SELECT boundary, a, b FROM mb
    WHERE (ka = 'TRANSFER' AND kb = 'GENERAL' AND oa) OR (ka = 'GENERAL' AND kb = 'TRANSFER' AND ob)""", "cells"))
def v05(spark: SparkSession, d: str) -> DataFrame:
    return views.space_connectivity(*model(spark, d))[1].select("boundary", "u", "v")


@query("v06_transfer_to_transfer")
def v06(spark: SparkSession, d: str) -> DataFrame:
    return views.transfer_to_transfer(*model(spark, d))


@query("v07_door_to_door")
def v07(spark: SparkSession, d: str) -> DataFrame:
    return views.door_to_door(*model(spark, d))


@query("b11_dual_edges", sql(f""", {MODEL}, mid AS (SELECT cell_id, (x0 + x1) / 2.0 AS x, (y0 + y1) / 2.0 AS y FROM cells) SELECT boundary, a, b,
    CASE WHEN sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) > 0 THEN round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), 6) ELSE 1.0 END AS weight FROM mb
    JOIN mid p ON a = p.cell_id JOIN mid q ON b = q.cell_id WHERE CASE WHEN ka = 'TRANSFER' THEN oa WHEN kb = 'TRANSFER' THEN ob ELSE true END""", "cells"))
def b11(spark: SparkSession, d: str) -> DataFrame:
    return builder.dual(*model(spark, d))[1].select("boundary", "a", "b", "weight")


@query("m06_discrete_run")
def m06(spark: SparkSession, d: str) -> DataFrame:
    """Everybody walks from their nation to its nearest exit, slowed by who shares an edge."""
    e, n = domain.edges(spark, d), domain.nodes(spark, d)
    costs = graph.distances(e, n)
    ends = graph.best_target(costs, n.where("node in (7, 19)")).where("source <> target")
    legs = graph.legs(graph.paths(costs, ends.select("source", "target"))).join(graph.symmetric(e), ["u", "v"])
    crowd = domain.table(spark, d, "customer").select(F.col("c_custkey").alias("agent"), F.col("c_nationkey").alias("source"))
    routes = crowd.join(legs, "source").select("agent", "leg", "u", "v", F.col("weight").cast("double").alias("length"))
    return sim.discrete(crowd, routes, 12, tick=60.0)


@query("m_continuous_runs")
def m_continuous(spark: SparkSession, d: str) -> DataFrame:
    """One run a nation: its suppliers leave a hall with two exits."""
    a = domain.table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("run"), F.col("s_suppkey").alias("agent"), F.lit("Adult").alias("profile"), (F.col("s_suppkey") % 17 + 1).cast("double").alias("x"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("y"))
    return sim.continuous(a.select("run"), a, [(20.0, 4.0), (0.0, 4.0)], [(0.0, 0.0, 20.0, 0.0), (0.0, 8.0, 20.0, 8.0)], 300)
