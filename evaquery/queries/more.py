"""Further operators of the inventory over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalars
from ..operators import aggregates, filters, windows
from ..plans import graph
from ..registry import query
from ..sources import domain
from ..sources.domain import sql, table
from .hazards import REACH, SYM
from .relational import MOVES, WALKERS


@query("p01_optional_filter", sql("SELECT cell_id, level, kind FROM cells WHERE kind = 'TRANSFER'", "cells"))
def p01(spark: SparkSession, d: str) -> DataFrame:
    return filters.optional_equal(domain.cells(spark, d), level=None, kind="TRANSFER").select("cell_id", "level", "kind")


@query("p05_p07_exits_and_positive_edges", sql("""SELECT u, v, weight FROM edges WHERE weight > 3 AND (u IN (SELECT node FROM nodes
    WHERE is_exit OR upper(function_code) IN ('EXIT','EMERGENCY_EXIT')) OR v IN (SELECT node FROM nodes
    WHERE is_exit OR upper(function_code) IN ('EXIT','EMERGENCY_EXIT')))""", "nodes", "edges"))
def p05(spark: SparkSession, d: str) -> DataFrame:
    exits = domain.nodes(spark, d).where(filters.is_exit()).select("node")
    e = filters.positive(domain.edges(spark, d).withColumn("weight", F.col("weight") - 3)).withColumn("weight", F.col("weight") + 3)
    return e.join(exits, (F.col("u") == F.col("node")) | (F.col("v") == F.col("node")), "left_semi")


@query("p19_level_counts", sql("SELECT level, kind, count(*) AS n FROM cells WHERE level = 1 GROUP BY 1, 2", "cells"))
def p19(spark: SparkSession, d: str) -> DataFrame:
    return domain.cells(spark, d).where("level = 1").groupBy("level", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("p20_layer_selection", sql("SELECT cell_id, kind FROM cells WHERE kind IN ('TRANSFER')", "cells"))
def p20(spark: SparkSession, d: str) -> DataFrame:
    c = domain.cells(spark, d).withColumn("navigation_type", F.when(F.col("kind") == "TRANSFER", "TransferSpace").otherwise("GeneralSpace"))
    return filters.in_layers(c, "transfer, object").select("cell_id", "kind")


@query("j01_j02_node_cell_joins", sql("SELECT c.cell_id, n.node, n.kind AS node_kind FROM cells c LEFT JOIN nodes n ON c.cell % 40 = n.node", "cells", "nodes"))
def j01(spark: SparkSession, d: str) -> DataFrame:
    n = domain.nodes(spark, d).select("node", F.col("kind").alias("node_kind"))
    return domain.cells(spark, d).withColumn("k", (F.col("cell") % 40).cast("int")).join(n, F.col("k") == F.col("node"), "left").select("cell_id", "node", "node_kind")


@query("j16_fire_edge_penalties", sql(""", m AS (SELECT u, v, (a.x + b.x) / 2.0 AS x, (a.y + b.y) / 2.0 AS y FROM edges JOIN nodes a ON u = a.node
    JOIN nodes b ON v = b.node) SELECT u, v, count(*) AS fires FROM m JOIN nodes f ON f.node % 3 = 0 AND (f.x - m.x) ** 2 + (f.y - m.y) ** 2 <= 100
    GROUP BY u, v""", "nodes", "edges"))
def j16(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.joins import within

    n = domain.nodes(spark, d)
    at = lambda k: n.select(F.col("node").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    m = domain.edges(spark, d).join(at("u"), "u").join(at("v"), "v").select("u", "v", ((F.col("ux") + F.col("vx")) / 2.0).alias("x"), ((F.col("uy") + F.col("vy")) / 2.0).alias("y"))
    return within(m, n.where("node % 3 = 0").select("node", "x", "y"), 10.0).groupBy(F.col("p_u").alias("u"), F.col("p_v").alias("v")).agg(F.count(F.lit(1)).alias("fires"))


@query("j23_w04_door_edges", sql("""SELECT 'EG-' || lpad(CAST(row_number() OVER (ORDER BY a.node, b.node) AS VARCHAR), 4, '0') AS id, a.node AS a,
    b.node AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS cost FROM nodes a JOIN nodes b ON a.level = b.level AND a.node < b.node""", "nodes"))
def j23(spark: SparkSession, d: str) -> DataFrame:
    n = domain.nodes(spark, d)
    a, b = n.select("level", F.col("node").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), n.select("level", F.col("node").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    pairs = a.join(b, "level").where("a < b")
    return windows.global_row_number(pairs, "a", "b").select(F.concat(F.lit("EG-"), F.lpad(F.col("n").cast("string"), 4, "0")).alias("id"), "a", "b", F.round(G.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")), 6).alias("cost"))


@query("j26_score_default", sql("SELECT c.cell_id, coalesce(n.score, 1.0) AS score FROM cells c LEFT JOIN nodes n ON c.cell % 60 = n.node", "cells", "nodes"))
def j26(spark: SparkSession, d: str) -> DataFrame:
    n = domain.nodes(spark, d).select("node", "score")
    return domain.cells(spark, d).withColumn("k", (F.col("cell") % 60).cast("int")).join(n, F.col("k") == F.col("node"), "left").select("cell_id", F.coalesce("score", F.lit(1.0)).alias("score"))


@query("j27_two_sided_membership", sql("SELECT u || '-' || v AS boundary, u AS cell FROM edges UNION ALL SELECT u || '-' || v, v FROM edges", "edges"))
def j27(spark: SparkSession, d: str) -> DataFrame:
    return domain.edges(spark, d).select(F.concat_ws("-", F.col("u").cast("string"), F.col("v").cast("string")).alias("boundary"), F.explode(F.array("u", "v")).alias("cell"))


@query("a04_merged_contacts", sql(""", c AS (SELECT least(u, v) AS u, greatest(u, v) AS v, 'B' || weight AS b,
    CASE WHEN weight % 2 = 0 THEN 'door' ELSE 'wall' END AS k, weight % 2 = 0 AS t FROM edges UNION ALL SELECT u, v, 'X', 'virtual', false FROM edges
    WHERE weight > 8) SELECT u, v, list_sort(list_distinct(list(b))) AS boundaries, list_sort(list_distinct(list(k))) AS kinds, bool_or(t) AS
    traversable FROM c GROUP BY u, v""", "edges"))
def a04(spark: SparkSession, d: str) -> DataFrame:
    e = domain.edges(spark, d)
    even = F.col("weight") % 2 == 0
    first = e.select(F.col("v").alias("u"), F.col("u").alias("v"), F.concat(F.lit("B"), F.col("weight").cast("string")).alias("boundary"), F.when(even, "door").otherwise("wall").alias("kind"), even.alias("traversable"))
    second = e.where("weight > 8").select("u", "v", F.lit("X").alias("boundary"), F.lit("virtual").alias("kind"), F.lit(False).alias("traversable"))
    return aggregates.merged_contacts(first.unionByName(second))


@query("a05_edge_numbers", sql("SELECT 'SAG_' || lpad(CAST(row_number() OVER (ORDER BY u, v) AS VARCHAR), 3, '0') AS edge, u, v FROM edges", "edges"))
def a05(spark: SparkSession, d: str) -> DataFrame:
    from ..plans.views import numbered

    return numbered(domain.edges(spark, d).select("u", "v"), "SAG").select("edge", "u", "v")


@query("a16_status_by_block", sql("""SELECT CAST(step // 5 AS INTEGER) AS block, count(*) FILTER (WHERE event = 'EVACUACION_COMPLETA') AS done,
    count(*) FILTER (WHERE event <> 'EVACUACION_COMPLETA') AS moving FROM log GROUP BY 1""", "log"))
def a16(spark: SparkSession, d: str) -> DataFrame:
    over = F.col("event") == "EVACUACION_COMPLETA"
    return domain.event_log(spark, d).groupBy(F.floor(F.col("step") / 5).cast("int").alias("block")).agg(F.count_if(over).alias("done"), F.count_if(~over).alias("moving"))


@query("a22_a23_limits_and_severity", sql("""SELECT room, least(min(CASE WHEN variable = 'view' AND value > 50 THEN 3.0 END), min(CASE WHEN variable
    = 'click' AND value > 50 THEN 5.0 END)) AS t_max, greatest(max(CASE WHEN variable = 'view' THEN CAST(value > 50 AS INTEGER) END), max(CASE WHEN
    variable = 'click' THEN CAST(value > 90 AS INTEGER) * 2 END)) AS severity FROM readings GROUP BY room""", "readings"))
def a22(spark: SparkSession, d: str) -> DataFrame:
    v, x = F.col("variable"), F.col("value")
    limit = F.least(F.min(F.when((v == "view") & (x > 50), 3.0)), F.min(F.when((v == "click") & (x > 50), 5.0)))
    level = F.greatest(F.max(F.when(v == "view", (x > 50).cast("int"))), F.max(F.when(v == "click", (x > 90).cast("int") * 2)))
    return domain.readings(spark, d).groupBy("room").agg(limit.alias("t_max"), level.alias("severity"))


@query("a25_combined_windows", sql("SELECT room, min(value) AS least, arg_max(value, event_id) AS last FROM readings GROUP BY room", "readings"))
def a25(spark: SparkSession, d: str) -> DataFrame:
    return domain.readings(spark, d).groupBy("room").agg(F.min("value").alias("least"), F.max_by("value", "event_id").alias("last"))


@query("a28_robust_share", sql("SELECT u AS path_id, avg(CASE WHEN weight > 8 THEN 1.0 ELSE 0.0 END) AS share FROM edges GROUP BY u", "edges"))
def a28(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.robust_share(domain.edges(spark, d).select(F.col("u").alias("path_id"), (F.col("weight") > 8).alias("robust")))


@query("w08_replan_flags", sql("SELECT event_id, lag(event) OVER (PARTITION BY agent ORDER BY step, event_id) IS DISTINCT FROM event AS replan FROM log", "log"))
def w08(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("event").over(Window.partitionBy("agent").orderBy("step", "event_id"))
    return domain.event_log(spark, d).select("event_id", (~before.eqNullSafe(F.col("event"))).alias("replan"))


@query("w12_sliding_room_means", sql("""SELECT event_id, round(avg(value) OVER (PARTITION BY room
    ORDER BY ts RANGE BETWEEN INTERVAL 30 HOURS PRECEDING AND CURRENT ROW), 6) AS mean FROM readings""", "readings"))
def w12(spark: SparkSession, d: str) -> DataFrame:
    domain.readings(spark, d).createOrReplaceTempView("sliding_readings")
    return spark.sql("""SELECT event_id, round(avg(value) OVER (PARTITION BY room
    ORDER BY ts RANGE BETWEEN INTERVAL 30 HOURS PRECEDING AND CURRENT ROW), 6) AS mean FROM sliding_readings""")


@query("w15_part_numbers", sql("""SELECT cell_id, 'PART_' || lpad(CAST(row_number() OVER (PARTITION BY level
    ORDER BY cell) AS VARCHAR), 4, '0') AS part, count(*) OVER (PARTITION BY level) AS parts FROM cells""", "cells"))
def w15(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("level")
    return domain.cells(spark, d).select("cell_id", F.concat(F.lit("PART_"), F.lpad(F.row_number().over(by.orderBy("cell")).cast("string"), 4, "0")).alias("part"), F.count(F.lit(1)).over(by).alias("parts"))


@query("o03_levels_in_order", "SELECT r_regionkey AS id, r_name AS name FROM region ORDER BY r_regionkey, r_name")
def o03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")).orderBy("id", "name")


@query("o06_top_two_by_contact", sql("""SELECT u, v, weight FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY weight DESC, v) AS rk
    FROM edges) WHERE rk <= 2""", "edges"))
def o06(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("weight"), "v"))
    return domain.edges(spark, d).withColumn("rk", rank).where("rk <= 2").select("u", "v", "weight")


@query("o11_longest_edge", sql("SELECT u, max(weight) AS longest, arg_max(v, weight * 100 - v) AS v FROM edges GROUP BY u", "edges"))
def o11(spark: SparkSession, d: str) -> DataFrame:
    return domain.edges(spark, d).groupBy("u").agg(F.max("weight").alias("longest"), F.max_by("v", F.col("weight") * 100 - F.col("v")).alias("v"))


@query("u04_changed_sets", sql("""SELECT count(*) > 0 AS changed FROM ((SELECT node FROM nodes WHERE coalesce(score, 1.0) >= 0.6 EXCEPT SELECT node
    FROM nodes WHERE coalesce(score, 1.0) >= 0.5) UNION ALL (SELECT node FROM nodes WHERE coalesce(score, 1.0) >= 0.5 EXCEPT SELECT node FROM nodes
    WHERE coalesce(score, 1.0) >= 0.6))""", "nodes"))
def u04(spark: SparkSession, d: str) -> DataFrame:
    n = domain.nodes(spark, d)
    a, b = n.where(filters.safe(0.6)).select("node"), n.where(filters.safe(0.5)).select("node")
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg((F.count(F.lit(1)) > 0).alias("changed"))


@query("u06_u07_key_sets", sql(""", k AS (SELECT room, list_sort(list_distinct(list(variable))) AS ks FROM readings WHERE event_id % 2 = 0
    GROUP BY room), l AS (SELECT room, list_sort(list_distinct(list(variable))) AS ks FROM readings WHERE event_id % 2 = 1 GROUP BY room)
    SELECT room, list_sort(CASE WHEN len(list_intersect(k.ks, l.ks)) > 0 THEN list_intersect(k.ks, l.ks) ELSE list_distinct(list_concat(k.ks, l.ks))
    END) AS shared FROM k JOIN l USING (room)""", "readings"))
def u06(spark: SparkSession, d: str) -> DataFrame:
    r = domain.readings(spark, d)
    side = lambda k, name: r.where(F.col("event_id") % 2 == k).groupBy("room").agg(F.sort_array(F.collect_set("variable")).alias(name))
    return side(0, "a").join(side(1, "b"), "room").select("room", scalars.shared_locomotion(F.col("a"), F.col("b")).alias("shared"))


@query("f10_f31_clamped", sql("""SELECT cell, round(least(greatest((x0 - 100) / 200.0, 0.0), 1.0), 6) AS share, round(10.0 + (20.0 - 10.0) *
    least(greatest((x0 - 100) / 200.0, 0.0), 1.0), 6) AS mixed FROM cells""", "cells"))
def f10(spark: SparkSession, d: str) -> DataFrame:
    t = scalars.clamp((F.col("x0") - 100) / 200.0)
    return domain.cells(spark, d).select("cell", scalars.rounded6(t).alias("share"), scalars.rounded6(scalars.lerp(F.lit(10.0), F.lit(20.0), t)).alias("mixed"))


@query("f37_payload_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def f37(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("g22_boundary_keys", sql("SELECT cell, md5(concat_ws('|', x0, y0, x1, y1)) AS k FROM cells", "cells"))
def g22(spark: SparkSession, d: str) -> DataFrame:
    return domain.cells(spark, d).select("cell", G.boundary_key(F.col("x1"), F.col("y1"), F.col("x0"), F.col("y0")).alias("k"))


@query("g41_stacked_levels", sql(""", b AS (SELECT level, min(y0) AS low, max(y1) AS high FROM cells
    GROUP BY level), s AS (SELECT max(greatest(1.35 * (high - low), (high - low) + 4, 4)) AS step FROM b)
    SELECT c.cell, round(c.y0 + c.level * s.step, 6) AS y FROM cells c, s""", "cells"))
def g41(spark: SparkSession, d: str) -> DataFrame:
    c = domain.cells(spark, d)
    h = F.col("high") - F.col("low")
    step = c.groupBy("level").agg(F.min("y0").alias("low"), F.max("y1").alias("high")).agg(F.max(F.greatest(1.35 * h, h + 4, F.lit(4))).alias("step"))
    return c.join(F.broadcast(step), how="cross").select("cell", F.round(F.col("y0") + F.col("level") * F.col("step"), 6).alias("y"))


@query("r07_relaxed_threshold", sql(f""", {SYM.replace('FROM edges', 'FROM ok')}, {REACH}
    SELECT source, min(CASE WHEN node IN (7, 19) THEN CAST(cost AS DOUBLE) END) AS cost FROM r GROUP BY source""", "nodes", "edges", recursive=True).replace("sym AS (", f"""ok
    AS (SELECT u, v, weight FROM edges WHERE u IN (SELECT node FROM nodes WHERE {MOVES}) AND v IN (SELECT node FROM nodes WHERE {MOVES})), sym AS (""", 1))
def r07(spark: SparkSession, d: str) -> DataFrame:
    n = domain.nodes(spark, d)
    ok = n.where(filters.mobility_allowed(WALKERS))
    best = graph.reach(filters.induced(domain.edges(spark, d), ok), n.where("node in (7, 19)"))
    return n.select(F.col("node").alias("source")).join(best.select(F.col("node").alias("source"), "cost"), "source", "left")


@query("r15_r20_degrees", sql("SELECT node, count(*) AS degree FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) GROUP BY node", "edges"))
def r15(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.degrees(domain.edges(spark, d))


@query("r18_congestion", sql(""", m AS (SELECT u, v, weight, (a.x + b.x) / 2.0 AS x, (a.y + b.y) / 2.0 AS y FROM edges JOIN nodes a ON u = a.node
    JOIN nodes b ON v = b.node) SELECT u, v, CAST(weight + 2.0 * (SELECT count(*) FROM nodes f
    WHERE (f.x - m.x) ** 2 + (f.y - m.y) ** 2 <= 9) AS DOUBLE) AS weight FROM m""", "nodes", "edges"))
def r18(spark: SparkSession, d: str) -> DataFrame:
    from ..plans.legacy import congested

    n = domain.nodes(spark, d)
    at = lambda k: n.select(F.col("node").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    m = domain.edges(spark, d).join(at("u"), "u").join(at("v"), "v").select("u", "v", "weight", ((F.col("ux") + F.col("vx")) / 2.0).alias("x"), ((F.col("uy") + F.col("vy")) / 2.0).alias("y"))
    return congested(m, n).select("u", "v", F.col("weight").cast("double").alias("weight"))


@query("b13_back_references", sql("""SELECT node, list_sort(list(b)) AS boundaries FROM (SELECT u AS node, u || '-' || v AS b FROM edges UNION ALL
    SELECT v, u || '-' || v FROM edges) GROUP BY node""", "edges"))
def b13(spark: SparkSession, d: str) -> DataFrame:
    return j27(spark, d).groupBy(F.col("cell").alias("node")).agg(F.sort_array(F.collect_list("boundary")).alias("boundaries"))
