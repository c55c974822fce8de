"""The indoor domain seen through star-schema tables.

Cells come from ``part``, the navigation graph from ``nation`` and the line items that
join customers' to suppliers' nations, readings and the evacuation log from ``events``.
Each frame has a twin in SQL (the CTEs at the end) over the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import numbered
from .storage import tasks

#: Parts that one task makes a floor plan of, three rows each; a file of many parts may be one split, whose task would aggregate them all.
PLAN_PARTS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangular cells on three levels, with kind, locomotion, function and exit flag."""
    k, s = F.col("p_partkey"), F.col("p_size")
    function = F.element_at(F.array(*map(F.lit, ["SPACE", "ADMIN", "STORAGE", "OFFICE", "CORRIDOR", "HALL", "STAIRS", "ELEVATOR", "ESCALATOR", "RAMP", "LOBBY", "DOOR", "WINDOW"])), (s % 13 + 1).cast("int"))
    base = table(spark, sf_dir, "part").select(
        k.alias("cell"), numbered("CS-", k, 6).alias("cell_id"), "p_name", (k % 3).cast("int").alias("level"),
        ((k - 1) % 50 * 10).cast("int").alias("x0"), F.expr("(p_partkey - 1) div 50 * 10").cast("int").alias("y0"), (8 + s % 5).cast("int").alias("w"), (8 + s % 4).cast("int").alias("h"),
        F.when(s % 13 >= 6, "TRANSFER").otherwise("GENERAL").alias("kind"), function.alias("function_code"),
        F.when(s % 13 >= 6, F.element_at(F.array(*map(F.lit, ["WALK", "STAIRS", "ELEVATOR", "RAMP"])), (k % 4 + 1).cast("int"))).alias("locomotion"), (k % 97 == 0).alias("is_exit"),
    )
    return base.withColumn("x1", F.col("x0") + F.col("w")).withColumn("y1", F.col("y0") + F.col("h"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node a nation, its region the level, with position, kind, locomotion, flags and score."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        n.alias("node"), F.col("n_regionkey").alias("level"), (n % 5 * 10).cast("int").alias("x"), (F.floor(n / 5) * 10).cast("int").alias("y"),
        F.when(n % 3 == 0, "TRANSFER").otherwise("GENERAL").alias("kind"), F.when(n % 3 == 0, F.when(n % 2 == 0, "WALK").otherwise("STAIRS")).alias("locomotion"),
        n.isin(7, 19).alias("is_exit"), F.when(n == 19, "EXIT").when(n == 13, "window").otherwise("ROOM").alias("function_code"),
        F.when(n % 6 != 5, F.round(1 - (n % 10) / F.lit(10.0), 1)).alias("score"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges u < v between all nations that trade."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("a"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b"))
    trade = line.join(order, line.l_orderkey == order.o_orderkey).join(customer, order.o_custkey == customer.c_custkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
    pairs = trade.where("a <> b").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.select("u", "v", (1 + F.col("n") % 17).cast("int").alias("weight"))


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large graph: orders (even nodes) and the parts in them (odd nodes), weighted by the least quantity."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy((2 * F.col("l_orderkey")).alias("u"), (2 * F.col("l_partkey") + 1).alias("v")).agg(F.min("l_quantity").cast("double").alias("weight"))


def stock_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders and parts as nodes of ``stock``, with links or without."""
    return table(spark, sf_dir, "orders").select((2 * F.col("o_orderkey")).alias("node")).union(table(spark, sf_dir, "part").select(2 * F.col("p_partkey") + 1))


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A floor plan: a room for each part on a grid of 50 columns, with a passage to the room on its right and one
    to the room above; each passage is a door, exit, window, stair or ramp by the part's size. Parts are dealt over tasks before they are rooms."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    n = tasks(parts, PLAN_PARTS)
    base = (parts.repartition(n, "p_partkey") if n > 1 else parts).select(k.alias("k"), "p_size", ((k - 1) % 50 * 10).cast("int").alias("x"), F.expr("(p_partkey - 1) div 50 * 10").cast("int").alias("y"))
    box = lambda name, tag, x0, y0, x1, y1, category: F.struct((F.col("k") * 3 + tag).alias("cell"), numbered(name, F.col("k"), 6).alias("name"), (F.col("x") + x0).alias("x0"), (F.col("y") + y0).alias("y0"), (F.col("x") + x1).alias("x1"), (F.col("y") + y1).alias("y1"), category.alias("category"))
    kinds = F.array(*map(F.lit, ("Door", "Door", "Exit", "Window", "Door", "Stair", "Door", "Ramp")))
    kind = lambda shift: F.get(kinds, ((F.col("p_size") + shift) % 8).cast("int"))
    boxes = F.array(box("CS_L00_ROOM_", 0, 0, 0, 9, 9, F.lit("Room")), box("CS_L00_EAST_", 1, 9, 3, 10, 5, kind(0)), box("CS_L00_NORTH_", 2, 3, 9, 6, 10, kind(3)))
    cells = base.select(F.inline(boxes))
    kind = F.when(F.col("category") == "Room", "GeneralSpace").otherwise("TransferSpace")
    return cells.withColumn("level", F.lit(0)).withColumn("navigation_type", kind).withColumn("traversable", F.col("category") != "Window")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of few nodes, for rules that SQL can only check by listing every route: trade between regions, weighted by its volume."""
    area = table(spark, sf_dir, "nation")
    of = lambda end: area.select(F.col("n_nationkey").alias(end), F.col("n_regionkey").cast("long").alias(f"r{end}"))
    pairs = edges(spark, sf_dir).join(of("u"), "u").join(of("v"), "v").where("ru <> rv")
    return pairs.groupBy(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).agg(F.sum(F.col("weight") * F.col("weight") + F.col("u") * F.col("v")).cast("double").alias("weight"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor readings: a user is a room, an event type a variable."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("room"), F.col("event_type").alias("variable"), "ts", "value", "props")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evacuation log: steps are hours since the table's first day."""
    names = {"purchase": "CAMBIO_RUTA", "error": "RECALCULO", "signup": "EVACUACION_COMPLETA", "click": "FUEGO_CREADO"}
    kind = F.lit("OTHER")
    for event, name in names.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    step = F.floor(F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")) / 3600).cast("int")
    return table(spark, sf_dir, "events").select("event_id", step.alias("step"), F.col("user_id").alias("agent"), kind.alias("event"), F.col("value"))


#: The same frames as DuckDB CTEs.
CTE = {
    "cells": """cells AS (SELECT p_partkey AS cell, 'CS-' || CASE WHEN p_partkey > 999999 THEN CAST(p_partkey AS VARCHAR) ELSE lpad(CAST(p_partkey AS VARCHAR), 6, '0') END AS cell_id, p_name, CAST(p_partkey % 3 AS INTEGER) AS level,
 CAST((p_partkey - 1) % 50 * 10 AS INTEGER) AS x0, CAST((p_partkey - 1) // 50 * 10 AS INTEGER) AS y0, CAST(8 + p_size % 5 AS INTEGER) AS w, CAST(8 + p_size % 4 AS INTEGER) AS h,
 CASE WHEN p_size % 13 >= 6 THEN 'TRANSFER' ELSE 'GENERAL' END AS kind,
 (['SPACE','ADMIN','STORAGE','OFFICE','CORRIDOR','HALL','STAIRS','ELEVATOR','ESCALATOR','RAMP','LOBBY','DOOR','WINDOW'])[p_size % 13 + 1] AS function_code,
 CASE WHEN p_size % 13 >= 6 THEN (['WALK','STAIRS','ELEVATOR','RAMP'])[p_partkey % 4 + 1] END AS locomotion, p_partkey % 97 = 0 AS is_exit,
 CAST((p_partkey - 1) % 50 * 10 + 8 + p_size % 5 AS INTEGER) AS x1, CAST((p_partkey - 1) // 50 * 10 + 8 + p_size % 4 AS INTEGER) AS y1 FROM part)""",
    "nodes": """nodes AS (SELECT n_nationkey AS node, n_regionkey AS level, CAST(n_nationkey % 5 * 10 AS INTEGER) AS x, CAST(n_nationkey // 5 * 10 AS INTEGER) AS y,
 CASE WHEN n_nationkey % 3 = 0 THEN 'TRANSFER' ELSE 'GENERAL' END AS kind, CASE WHEN n_nationkey % 3 = 0 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'WALK' ELSE 'STAIRS' END END AS locomotion,
 n_nationkey IN (7, 19) AS is_exit, CASE n_nationkey WHEN 19 THEN 'EXIT' WHEN 13 THEN 'window' ELSE 'ROOM' END AS function_code,
 CASE WHEN n_nationkey % 6 <> 5 THEN round(1 - (n_nationkey % 10) / 10.0::DOUBLE, 1) END AS score FROM nation)""",
    "edges": """edges AS (SELECT u, v, CAST(1 + n % 17 AS INTEGER) AS weight FROM (SELECT least(c_nationkey, s_nationkey) AS u, greatest(c_nationkey, s_nationkey) AS v, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2))""",
    "plan": """plan0 AS (SELECT p_partkey AS k, p_size AS s, CAST((p_partkey - 1) % 50 * 10 AS INTEGER) AS x, CAST((p_partkey - 1) // 50 * 10 AS INTEGER) AS y, CASE WHEN p_partkey > 999999 THEN CAST(p_partkey AS VARCHAR) ELSE lpad(CAST(p_partkey AS VARCHAR), 6, '0') END AS id,
 ['Door', 'Door', 'Exit', 'Window', 'Door', 'Stair', 'Door', 'Ramp'] AS kinds FROM part),
plan AS (SELECT *, 0 AS level, CASE WHEN category = 'Room' THEN 'GeneralSpace' ELSE 'TransferSpace' END AS navigation_type, category <> 'Window' AS traversable FROM (
 SELECT k * 3 AS cell, 'CS_L00_ROOM_' || id AS name, x AS x0, y AS y0, x + 9 AS x1, y + 9 AS y1, 'Room' AS category FROM plan0
 UNION ALL SELECT k * 3 + 1, 'CS_L00_EAST_' || id, x + 9, y + 3, x + 10, y + 5, kinds[s % 8 + 1] FROM plan0 UNION ALL SELECT k * 3 + 2, 'CS_L00_NORTH_' || id, x + 3, y + 9, x + 6, y + 10, kinds[(s + 3) % 8 + 1] FROM plan0))""",
    "regions": """regions AS (SELECT least(a.n_regionkey, b.n_regionkey) AS u, greatest(a.n_regionkey, b.n_regionkey) AS v, CAST(sum(weight * weight + u * v) AS DOUBLE) AS weight FROM edges JOIN nation a ON u = a.n_nationkey JOIN nation b ON v = b.n_nationkey
 WHERE a.n_regionkey <> b.n_regionkey GROUP BY 1, 2)""",
    "stock": "stock AS (SELECT 2 * l_orderkey AS u, 2 * l_partkey + 1 AS v, CAST(min(l_quantity) AS DOUBLE) AS weight FROM lineitem GROUP BY 1, 2)",
    "stock_nodes": "stock_nodes AS (SELECT 2 * o_orderkey AS node FROM orders UNION ALL SELECT 2 * p_partkey + 1 FROM part)",
    "readings": "readings AS (SELECT event_id, user_id AS room, event_type AS variable, ts, value, props FROM events)",
    "log": """log AS (SELECT event_id, CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 3600) AS INTEGER) AS step, user_id AS agent,
 CASE event_type WHEN 'purchase' THEN 'CAMBIO_RUTA' WHEN 'error' THEN 'RECALCULO' WHEN 'signup' THEN 'EVACUACION_COMPLETA' WHEN 'click' THEN 'FUEGO_CREADO' ELSE 'OTHER' END AS event, value FROM events)""",
}


def sql(query: str, *frames: str, recursive: bool = False) -> str:
    """``query`` (which may begin with further CTEs and a comma) behind the CTEs of ``frames``."""
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(CTE[f] for f in frames) + ("\n" if not query.lstrip().startswith(",") else "") + query
