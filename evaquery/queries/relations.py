"""Views, routes, rules and reports of the inventory over the floor plan and the other frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import geometry as G
from ..functions import ids
from ..operators import aggregates, dq, filters, joins, windows
from ..plans import builder, graph, legacy, routing, sim, topology, views
from ..registry import query
from ..sources import domain
from ..sources.domain import sql, table
from ..sources.storage import stored
from ..streaming import sensors

#: Which passage (via) touches which room, and where: worked out from the grid, not from the boxes.
TOUCH = """touch AS (SELECT v.name AS via, v.category, v.traversable AS open, r.name AS room, CASE WHEN v.t = 2 THEN (v.x0 + v.x1) / 2.0 WHEN r.k = v.k THEN v.x0 ELSE v.x1 END AS px, CASE WHEN v.t = 1 THEN (v.y0 + v.y1) / 2.0 WHEN r.k = v.k THEN v.y0 ELSE v.y1 END AS py
 FROM (SELECT *, cell // 3 AS k, cell % 3 AS t FROM plan WHERE cell % 3 > 0) v JOIN (SELECT name, cell // 3 AS k FROM plan WHERE cell % 3 = 0) r ON r.k = v.k OR (v.t = 1 AND r.k = v.k + 1 AND (v.k - 1) % 50 < 49) OR (v.t = 2 AND v.k > 0 AND r.k = v.k + 50))"""
NUMBER = "CASE WHEN row_number() OVER (ORDER BY u, v) < 1000 THEN lpad(CAST(row_number() OVER (ORDER BY u, v) AS VARCHAR), 3, '0') ELSE CAST(row_number() OVER (ORDER BY u, v) AS VARCHAR) END"
ADJACENT = f"""adj AS (SELECT u, v, list_sort(list_distinct(list(via))) AS boundaries, list_sort(list_distinct(list(kind))) AS kinds, bool_or(open) AS traversable FROM (
 SELECT a.room AS u, b.room AS v, a.via, a.open, CASE WHEN a.category IN ('Stair', 'Ramp') THEN 'connector' ELSE 'transfer' END AS kind FROM touch a JOIN touch b ON a.via = b.via AND a.room < b.room) GROUP BY u, v),
 numbered AS (SELECT u, v, boundaries, kinds, traversable, {NUMBER} AS no FROM adj)"""


def model(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(cells, boundaries) of the floor plan, as the views take them.

    Both are joined by shuffle: a part makes three rows, of which Spark's estimate knows
    nothing, so by the size of the file of parts it would broadcast millions of rows.
    """
    p = domain.plan(spark, d).hint("merge")
    r = G.rect()
    ring = F.array(*[F.array(x.cast("double"), y.cast("double")) for x, y in ((r["x0"], r["y0"]), (r["x1"], r["y0"]), (r["x1"], r["y1"]), (r["x0"], r["y1"]))])
    cells = p.select(F.col("name").alias("cell"), F.col("level").cast("string").alias("level"), "navigation_type", "category", "traversable", ((r["x0"] + r["x1"]) / 2).alias("x"), ((r["y0"] + r["y1"]) / 2).alias("y"), ring.alias("ring"))
    side = lambda end: p.select(F.col("cell").alias(f"k{end}"), F.col("name").alias(end), F.col("navigation_type").alias(f"t{end}"), F.col("traversable").alias(f"p{end}"))
    met = topology.contacts(p).select(F.col("a").alias("ka"), F.col("b").alias("kb"), *[F.col(o).cast("double").alias(n) for o, n in (("x0", "ax"), ("y0", "ay"), ("x1", "bx"), ("y1", "by"))], "length")
    both = met.join(side("a"), "ka").join(side("b"), "kb")
    return cells, both.select(F.concat_ws("-", F.lit("B"), F.col("ka").cast("string"), F.col("kb").cast("string")).alias("boundary"), "a", "b", F.lit(False).alias("is_virtual"), F.lit("general_transfer_contact").alias("role"), (F.col("pa") & F.col("pb")).alias("traversable"), "ax", "ay", "bx", "by", "length")


@query("v03_room_graph", sql(f", {TOUCH}, {ADJACENT} SELECT u, v, boundaries, kinds, traversable, 'RADJ_' || no AS edge FROM numbered", "plan"))
def v03(spark: SparkSession, d: str) -> DataFrame:
    return views.room_adjacency(*model(spark, d))


@query("v04_room_access", sql(f", {TOUCH}, {ADJACENT} SELECT u, v, boundaries, kinds, traversable, 'R2R_' || no AS edge FROM numbered WHERE traversable", "plan"))
def v04(spark: SparkSession, d: str) -> DataFrame:
    return views.room_to_room(*model(spark, d))


def ways(where: str, prefix: str) -> str:
    return sql(f""", {TOUCH}, w AS (SELECT a.room AS space, a.via AS u, b.via AS v, round(sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2), 6) AS
    distance FROM touch a JOIN touch b ON a.room = b.room AND a.via < b.via WHERE {where})
    SELECT space, u, v, distance, '{prefix}_' || {NUMBER} AS edge FROM w""", "plan")


@query("v06_ways_between_transfers", ways("true", "T2T"))
def v06(spark: SparkSession, d: str) -> DataFrame:
    return views.transfer_to_transfer(*model(spark, d))


@query("v07_ways_between_doors", ways("a.category IN ('Door', 'Exit') AND b.category IN ('Door', 'Exit')", "D2D"))
def v07(spark: SparkSession, d: str) -> DataFrame:
    return views.door_to_door(*model(spark, d))


@query("v08_b12_b14_vertical_links", sql(""", c AS (SELECT name, category, cell // 3 % 5 AS connector, cell // 3 AS k FROM plan
    WHERE category IN ('Stair', 'Ramp')), up AS (SELECT name AS u, lead(name) OVER (PARTITION BY connector ORDER BY k, name) AS v FROM c)
    SELECT 'node' AS kind, name AS u, category AS v FROM c UNION ALL SELECT 'vertical', u, v FROM up WHERE v IS NOT NULL""", "plan"))
def v08(spark: SparkSession, d: str) -> DataFrame:
    cells, bounds = model(spark, d)
    k = F.floor(F.col("cell") / 3)
    ends = domain.plan(spark, d).where("category in ('Stair', 'Ramp')").select((k % 5).alias("connector"), k.alias("level_order"), F.col("name").alias("level"), F.col("name").alias("cell"))
    nodes, edges = views.vertical_connectivity(cells, builder.vertical_links(ends), bounds)
    return nodes.select(F.lit("node").alias("kind"), F.col("node").alias("u"), F.col("category").alias("v")).unionByName(edges.select("kind", "u", "v"))


@query("b32_room_nodes", sql("SELECT name AS room, CAST(level AS VARCHAR) AS level, [name] AS cells FROM plan WHERE category = 'Room'", "plan"))
def b32(spark: SparkSession, d: str) -> DataFrame:
    return views.room_nodes(*model(spark, d))


@query("b09_b10_a02_exposed_borders", sql(f""", {TOUCH}, t AS (SELECT room AS cell, via, CASE WHEN via LIKE '%EAST%' THEN 2 ELSE 3 END AS len
    FROM touch UNION ALL SELECT via, room, CASE WHEN via LIKE '%EAST%' THEN 2 ELSE 3 END
    FROM touch), s AS (SELECT cell, sum(len) AS shared, count(*) AS lines FROM t GROUP BY 1)
    SELECT name AS cell, round(2.0 * (x1 - x0 + y1 - y0) - coalesce(shared, 0), 6)::DOUBLE AS exposed, lines, CAST(shared AS DOUBLE) AS length
    FROM plan LEFT JOIN s ON cell = name""".replace("SELECT name AS cell", "SELECT plan.name AS cell").replace("ON cell = name", "ON s.cell = plan.name"), "plan"))
def b09(spark: SparkSession, d: str) -> DataFrame:
    cells, bounds = model(spark, d)
    lines = aggregates.shared_lines(bounds.select("a", "b", F.col("ax").alias("x0"), F.col("ay").alias("y0"), F.col("bx").alias("x1"), F.col("by").alias("y1")))
    return builder.exposed_length(cells, bounds).join(lines, "cell", "left")


@query("j20_transfer_membership", sql(f", {TOUCH} SELECT DISTINCT via, room AS cell, category, open AS traversable FROM touch", "plan"))
def j20(spark: SparkSession, d: str) -> DataFrame:
    return views._members(*model(spark, d), ("TransferSpace",)).select("via", "cell", "category", "traversable")


@query("f35_x07_edge_modes", sql(f""", {TOUCH} SELECT 'navigation' AS mode, count(*) FILTER (WHERE open) AS edges FROM touch UNION ALL
    SELECT 'all_adjacency', count(*) FROM touch""", "plan"))
def x07(spark: SparkSession, d: str) -> DataFrame:
    cells, bounds = model(spark, d)
    n = lambda mode: builder.dual(cells, bounds, mode)[1].agg(F.count(F.lit(1)).alias("edges")).select(F.lit(mode).alias("mode"), "edges")
    return n("navigation").unionByName(n("all_adjacency"))


@query("q17_opening_rules", sql(f""", {TOUCH}, n AS (SELECT via, count(DISTINCT room) AS n FROM touch GROUP BY 1) SELECT
    CASE category WHEN 'Door' THEN 'door without two spaces' ELSE 'window without a space' END AS rule, name AS key FROM plan LEFT
    JOIN n ON via = name WHERE (category = 'Door' AND coalesce(n, 0) <> 2) OR (category = 'Window' AND coalesce(n, 0) < 1)""", "plan"))
def q17(spark: SparkSession, d: str) -> DataFrame:
    return dq.opening_faults(*model(spark, d))


# routes over a graph small enough to list every one of its routes
EVERY = """sy AS (SELECT u, v, weight FROM regions UNION ALL SELECT v, u, weight FROM regions),
walk(start, node, path, cost) AS (SELECT DISTINCT u, u, [u], 0.0::DOUBLE FROM sy UNION ALL SELECT start, v, list_append(path, v), cost + weight FROM walk JOIN sy ON node = u WHERE NOT list_contains(path, v)),
ways AS (SELECT start, path, cost FROM walk WHERE node = 4 AND start <> 4), main AS (SELECT start, arg_min(path, cost) AS path, min(cost) AS cost FROM ways GROUP BY 1),
legs AS (SELECT start, path, cost, i, [least(path[i], path[i + 1]), greatest(path[i], path[i + 1])] AS e FROM ways, range(1, 5) r(i) WHERE i < len(path)),
uses AS (SELECT start, path, list(e) AS es FROM legs GROUP BY 1, 2)"""


def asked(spark: SparkSession) -> DataFrame:
    return spark.range(4).select(F.col("id").alias("q"), F.col("id").alias("start"), F.lit(4).cast("long").alias("goal"))


@query("r10_r12_robust_routes", sql(f""", {EVERY}, lost AS (SELECT m.start, l.e, (SELECT min(w.cost) FROM ways w JOIN uses u ON u.start = w.start AND u.path = w.path WHERE w.start = m.start AND NOT list_contains(u.es, l.e)) AS again, m.cost FROM main m JOIN legs l ON l.start = m.start AND l.path = m.path),
    alt AS (SELECT l.start, l.e, arg_min(w.path, w.cost) AS path, min(w.cost) AS c, any_value(l.cost) AS cost FROM lost l JOIN ways w ON w.start = l.start JOIN uses u ON u.start = w.start AND u.path = w.path WHERE NOT list_contains(u.es, l.e) GROUP BY 1, 2)
    SELECT m.start, m.cost, (SELECT count(*) FROM lost l WHERE l.start = m.start AND l.again <= 1.5 * l.cost) AS kept, (SELECT count(*) FROM alt a WHERE a.start = m.start AND a.c <= 1.5 * a.cost) AS level1, (SELECT count(DISTINCT a.path) FROM alt a WHERE a.start = m.start AND a.c <= 1.5 * a.cost) AS distinct1 FROM main m""", "edges", "regions", recursive=True))  # fmt: skip
def r10(spark: SparkSession, d: str) -> DataFrame:
    """Of every main route: its cost, how many of its edges can be lost, and the alternatives that leaves."""
    got = routing.evacuation_centrality(domain.regions(spark, d), asked(spark))
    return got.select(F.col("q").alias("start"), "cost", F.col("level1").alias("kept"), "level1", "distinct1")


@query("r11_o08_most_robust", sql(f""", {EVERY}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY cost, path) AS rk, min(cost) OVER (PARTITION BY start) AS least FROM ways) WHERE rk <= 3 AND cost <= 1.5 * least),
    lost AS (SELECT n.start, n.path, n.cost, l.e, (SELECT min(w.cost) FROM ways w JOIN uses u ON u.start = w.start AND u.path = w.path WHERE w.start = n.start AND NOT list_contains(u.es, l.e)) AS again FROM near n JOIN legs l ON l.start = n.start AND l.path = n.path),
    rated AS (SELECT start, path, any_value(cost) AS cost, count(*) FILTER (WHERE again <= 1.5 * cost) AS robustness FROM lost GROUP BY 1, 2)
    SELECT start, cost, robustness, list_transform(path, x -> CAST(x AS BIGINT)) AS path FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY robustness DESC, cost, path) AS rn FROM rated) WHERE rn = 1""".replace("x -> CAST(x AS BIGINT)", "lambda x: CAST(x AS BIGINT)"), "edges", "regions", recursive=True))  # fmt: skip
def r11(spark: SparkSession, d: str) -> DataFrame:
    return routing.most_robust(domain.regions(spark, d), asked(spark)).select(F.col("q").alias("start"), "cost", "robustness", "path")


@query("r13_a14_route_counts", sql(f""", {EVERY} SELECT start, count(*) AS routes, count(DISTINCT path) AS distinct FROM (SELECT start, path FROM ways
    UNION ALL SELECT start, path FROM main) GROUP BY 1""".replace("AS distinct FROM", 'AS "distinct" FROM'), "edges", "regions", recursive=True))
def r13(spark: SparkSession, d: str) -> DataFrame:
    """All loopless routes, and the main one once more: how many, how many different."""
    e = domain.regions(spark, d)
    ways = routing.every_route(e, asked(spark)).unionByName(routing.k_routes(e, asked(spark), 1).drop("rank"))
    return aggregates.distinct_routes(ways.select(F.col("q").alias("start"), "path"), "start")


@query("r21_disjoint_routes", sql(""", sides AS (SELECT m, list_filter([0, 1, 2, 3], lambda n: (m >> n) & 1 = 1) AS side FROM range(1, 16) r(m))
    SELECT CAST(s AS BIGINT) AS start, min((SELECT count(*) FROM regions WHERE list_contains(side, u) <> list_contains(side, v))) AS routes
    FROM sides, range(0, 4) t(s) WHERE list_contains(side, s) GROUP BY 1""", "edges", "regions"))
def r21(spark: SparkSession, d: str) -> DataFrame:
    """Routes that share no edge; the SQL counts the least cut over all ways to part the nodes."""
    return routing.disjoint_routes(domain.regions(spark, d), asked(spark)).select(F.col("q").alias("start"), "routes")


@query("r14_betweenness", sql(f""", {EVERY.replace('WHERE node = 4 AND start <> 4', 'WHERE node <> start')}, best AS (SELECT start, path[-1] AS goal,
    arg_min(path, cost) AS path FROM ways GROUP BY 1, 2), inner_ AS (SELECT unnest(path[2:len(path) - 1]) AS node FROM best)
    SELECT CAST(n.node AS BIGINT) AS node, round((SELECT count(*) FROM inner_ i WHERE i.node = n.node) / 12.0, 6) AS score
    FROM (SELECT DISTINCT u AS node FROM sy) n""", "edges", "regions", recursive=True))
def r14(spark: SparkSession, d: str) -> DataFrame:
    e = domain.regions(spark, d)
    return routing.betweenness(e, spark.range(5).withColumnRenamed("id", "node")).select("node", F.round(F.col("score") / 12.0, 6).alias("score"))


@query("x04_r22_algorithms_by_name", sql(f""", {EVERY} SELECT g AS grp, CAST(start AS BIGINT) AS start, cost, len(path) AS stops
    FROM main, (VALUES ('astar'), ('dijkstra'), ('yen_ksp')) t(g)""", "edges", "regions", recursive=True))
def x04(spark: SparkSession, d: str) -> DataFrame:
    e, out = domain.regions(spark, d), None
    for name, search in routing.ALGORITHMS.items():
        own = search(e, asked(spark)).select(F.lit(name).alias("grp"), F.col("q").alias("start"), "cost", F.size("path").cast("bigint").alias("stops"))
        out = own if out is None else out.unionByName(own)
    return out


@query("x05_a13_a27_route_ratings", sql(f""", {EVERY} SELECT array_to_string(path, '-') AS path_id, round(min(s), 6) AS least, round(avg(s), 6) AS
    mean, round(CASE WHEN min(CASE WHEN i > 1 AND i < len(path) THEN c END) IS NULL THEN NULL ELSE exp(avg(CASE WHEN i > 1 AND i < len(path) THEN
    ln(c) END)) END, 6) AS agility FROM (SELECT start, path, i, 1 - path[i] / 10.0::DOUBLE AS s, path[i] + 1.0 AS c FROM ways, range(1, 6) r(i)
    WHERE i <= len(path)) GROUP BY path""", "edges", "regions", recursive=True))
def x05(spark: SparkSession, d: str) -> DataFrame:
    """Every route rated by its scores and by an agility that the caller hands in."""
    paths = stored(routing.every_route(domain.regions(spark, d), asked(spark)).select(F.array_join(F.col("path").cast("array<string>"), "-").alias("path_id"), "path"))
    nodes = spark.range(5).select(F.col("id").alias("node"))
    scores = aggregates.path_scores(paths, nodes.withColumn("score", 1 - F.col("node") / 10.0))
    return scores.withColumn("least", F.round("least", 6)).join(rated(paths, aggregates.geometric_agility, nodes.withColumn("c", F.col("node") + 1.0)), "path_id", "left").select("path_id", "least", "mean", F.round("agility", 6).alias("agility"))


def rated(paths: DataFrame, agility, centrality: DataFrame) -> DataFrame:
    """``agility`` (any function of paths and centralities) of the paths."""
    return agility(paths, centrality)


@query("r16_rolling_routes", sql(""", banned AS (SELECT node FROM nodes WHERE locomotion = 'STAIRS'), ok AS (SELECT u, v, weight FROM edges WHERE u NOT IN (SELECT node FROM banned) AND v NOT IN (SELECT node FROM banned) AND (u * 7 + v) % 25 NOT IN (SELECT node FROM banned)),
    sym AS (SELECT u, v, weight FROM ok UNION ALL SELECT v, u, weight FROM ok), r(node, cost, target) USING KEY (node) AS (SELECT node, 0.0::DOUBLE, node FROM nodes WHERE is_exit UNION SELECT node, b.cost, b.target FROM (SELECT s.v AS node, min({'cost': r.cost + s.weight, 'target': r.target}) AS b FROM r JOIN sym s ON r.node = s.u
    LEFT JOIN recurring.r o ON o.node = s.v WHERE o.cost IS NULL OR r.cost + s.weight < o.cost OR (r.cost + s.weight = o.cost AND r.target < o.target) GROUP BY 1)),
    near AS (SELECT c_custkey AS agent, arg_min(node, {'d': (x - c_custkey % 41) * (x - c_custkey % 41) + (y - c_custkey % 37) * (y - c_custkey % 37), 'n': node}) AS node FROM customer, nodes GROUP BY 1)
    SELECT agent, near.node AS start, target, cost FROM near LEFT JOIN r ON r.node = near.node""", "nodes", "edges", recursive=True))  # fmt: skip
def r16(spark: SparkSession, d: str) -> DataFrame:
    """From each agent's nearest node the cheapest exit without steps, and without ways through spaces that have them."""
    n = domain.nodes(spark, d)
    loco = F.when(F.col("locomotion") == "STAIRS", F.array(F.lit("Walking"))).otherwise(F.array(F.lit("Walking"), F.lit("Rolling")))
    ways_ = filters.without_banned(domain.edges(spark, d).withColumn("context", ((F.col("u") * 7 + F.col("v")) % 25).cast("int")), n.withColumn("locomotion_list", loco))
    agents = table(spark, d, "customer").select(F.col("c_custkey").alias("agent"), (F.col("c_custkey") % 41).alias("x"), (F.col("c_custkey") % 37).alias("y"))
    start = joins.nearest(agents, n, "agent", "node")
    return start.join(graph.reach(ways_, n.where("is_exit")), "node", "left").select("agent", F.col("node").alias("start"), "target", "cost")


@query("r23_runtime_graph", sql("""SELECT u, v, round(weight * (1 + 3 * greatest(1 - coalesce(a.score, 1.0), 1 - coalesce(b.score, 1.0))), 6) AS
    weight FROM edges JOIN nodes a ON u = a.node JOIN nodes b ON v = b.node WHERE weight <= 12 UNION ALL
    SELECT u, v, round(weight / 2.0 * (1 + 3 * greatest(1 - coalesce(a.score, 1.0), 1 - coalesce(b.score, 1.0))), 6) FROM edges
    JOIN nodes a ON u = a.node JOIN nodes b ON v = b.node WHERE weight <= 24""", "nodes", "edges"))
def r23(spark: SparkSession, d: str) -> DataFrame:
    e = domain.edges(spark, d)
    hazard = domain.nodes(spark, d).select("node", (1 - F.coalesce("score", F.lit(1.0))).alias("risk"))
    made = legacy.runtime_graph([e, e.withColumn("weight", F.col("weight") / 2.0)], F.col("weight") <= 12, hazard, "dynamic_weighted")
    return made.select("u", "v", F.round("weight", 6).alias("weight"))


# joins, sets, reports
@query("j04_orphans", """SELECT DISTINCT 'order without customer' AS rule, CAST(o_custkey AS VARCHAR) AS key FROM orders o WHERE NOT EXISTS (SELECT 1
    FROM customer c WHERE c.c_custkey = o.o_custkey AND c_acctbal > 1000)""")
def j04(spark: SparkSession, d: str) -> DataFrame:
    return dq.dangling(table(spark, d, "orders"), "order without customer", "o_custkey", table(spark, d, "customer").where("c_acctbal > 1000"), "c_custkey")


@query("j12_assigned_rooms", sql(""", p AS (SELECT s_suppkey AS point, s_suppkey * 7 % 520 AS x, s_suppkey * 3 % 50 AS y
    FROM supplier), rooms AS (SELECT * FROM plan WHERE category = 'Room'), i AS (SELECT point, min(name) AS room FROM p
    JOIN rooms ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1) SELECT point, coalesce(room, (SELECT min(name)
    FROM rooms)) AS room, room IS NULL AS inferred FROM p LEFT JOIN i USING (point)""", "plan"))
def j12(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("point"), (F.col("s_suppkey") * 7 % 520).alias("x"), (F.col("s_suppkey") * 3 % 50).alias("y"))
    return legacy.assigned(p, domain.plan(spark, d).where("category = 'Room'").select("name", "x0", "y0", "x1", "y1"))


@query("j17_join_by_tail", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j17(spark: SparkSession, d: str) -> DataFrame:
    """References of orders, of three segments, joined on their last one."""
    ref = table(spark, d, "orders").select("o_orderkey", ids.reference(F.lit("L"), F.col("o_orderstatus"), F.col("o_custkey").cast("string")).alias("ref"))
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("tail"), "c_name")
    return ref.withColumn("tail", ids.tail(F.col("ref"))).join(c, "tail").select("o_orderkey", "c_name")


@query("j18_s11_matrix_join", """SELECT i, j, CAST(CASE WHEN (i * 3 + j) % 10 / 10.0 < 0.4 AND (i + j) % 4 <> 0 THEN 0 ELSE i * 8 + j END AS BIGINT)
    AS cost FROM range(0, 8) a(i), range(0, 8) b(j)""")
def j18(spark: SparkSession, d: str) -> DataFrame:
    """Literal matrices in long form: costs cut where a known safety is too low."""
    both = spark.range(8).select(F.col("id").alias("i")).crossJoin(spark.range(8).select(F.col("id").alias("j")))
    safety = both.where("(i + j) % 4 <> 0").withColumn("safety", (F.col("i") * 3 + F.col("j")) % 10 / 10.0)
    return filters.safety_cut(both.withColumn("cost", F.col("i") * 8 + F.col("j")), safety, 0.4)


@query("j22_best_two_cells", sql(f""", {TOUCH} SELECT via, room, rk FROM (SELECT via, room, row_number() OVER (PARTITION BY via ORDER BY
    CASE WHEN via LIKE '%EAST%' THEN 2 ELSE 3 END DESC, room) AS rk FROM touch) WHERE rk <= 2""", "plan"))
def j22(spark: SparkSession, d: str) -> DataFrame:
    """The two cells that share most border with each passage."""
    cells, bounds = model(spark, d)
    rooms = cells.where("category = 'Room'").select(F.col("cell").alias("room"))
    sides = bounds.select(F.col("a").alias("via"), F.col("b").alias("room"), "length").union(bounds.select("b", "a", "length")).join(rooms, "room", "left_semi")
    rank = F.row_number().over(Window.partitionBy("via").orderBy(F.desc("length"), "room"))
    return sides.withColumn("rk", rank.cast("bigint")).where("rk <= 2").select("via", "room", "rk")


@query("b20_legacy_links", sql(""", r AS (SELECT cell, name, x0 - 0.15 AS x0, y0 - 0.15 AS y0, x1 + 0.15 AS x1, y1 + 0.15 AS y1 FROM plan WHERE category = 'Room'), dr AS (SELECT name, x0 * 1.0 + CASE WHEN x1 - x0 = 1 THEN 0.8 ELSE 0 END AS x0, y0, x1, y1 FROM plan WHERE category = 'Door'),
    b AS (SELECT r.name AS room, dr.name AS door FROM r JOIN dr ON (least(r.x1, dr.x1) - greatest(r.x0, dr.x0)) > 0 AND (least(r.y1, dr.y1) - greatest(r.y0, dr.y0)) > 0 AND (least(r.x1, dr.x1) - greatest(r.x0, dr.x0)) * (least(r.y1, dr.y1) - greatest(r.y0, dr.y0)) > 0.3 * (dr.x1 - dr.x0) * (dr.y1 - dr.y0))
    SELECT room AS origen, door AS destino, 'navegable_puerta' AS tipo, NULL AS contexto FROM b UNION ALL SELECT a.door, c.door, 'door_to_door', a.room FROM b a JOIN b c ON a.room = c.room AND a.door < c.door""", "plan"))  # fmt: skip
def b20(spark: SparkSession, d: str) -> DataFrame:
    p = domain.plan(spark, d)
    box = ["name", "x0", "y0", "x1", "y1"]
    doors = p.where("category = 'Door'").withColumn("x0", F.when(F.col("x1") - F.col("x0") == 1, F.col("x0") + 0.8).otherwise(F.col("x0").cast("double")))
    return legacy.links(p.where("category = 'Room'").select(*box), doors.select(*box))


@query("b22_layer_links", sql("""SELECT name AS nodo_id, CASE category WHEN 'Room' THEN 'adyacencia_fisica' ELSE 'navegable_puerta' END AS
    capa_superior, CASE category WHEN 'Room' THEN 'navegable_puerta' ELSE 'door_to_door' END AS capa_inferior, 'representa_el_mismo_espacio' AS
    tipo_conexion FROM plan WHERE category IN ('Room', 'Door', 'Exit')""", "plan"))
def b22(spark: SparkSession, d: str) -> DataFrame:
    klass = F.when(F.col("category") == "Room", "NavigableSpace").when(F.col("category") == "Door", "TransferSpace").when(F.col("category") == "Exit", "AnchorSpace")
    return legacy.layer_links(domain.plan(spark, d).select("name", klass.alias("klass")))


@query("t20_beacon_cells", sql("""SELECT b.node AS beacon, c.node AS cell FROM nodes b
    JOIN nodes c ON sqrt((b.x - c.x) ** 2 + (b.y - c.y) ** 2) <= 8 + b.node % 7 WHERE b.node % 3 = 0 UNION ALL
    SELECT node, unnest([node, (node + 1) % 25]) FROM nodes WHERE node % 3 = 1""", "nodes"))
def t20(spark: SparkSession, d: str) -> DataFrame:
    n = domain.nodes(spark, d)
    refs = F.when(F.col("node") % 3 == 1, F.array(F.col("node"), ((F.col("node") + 1) % 25).cast(n.schema["node"].dataType)))
    b = n.where("node % 3 <> 2").select(F.col("node").alias("beacon"), refs.alias("refs"), (8.0 + F.col("node") % 7).alias("radius"), "x", "y")
    return legacy.beacon_cells(b, n.select(F.col("node").alias("cell"), "x", "y"))


@query("t10_presence_sessions", """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events
    WHERE value > 0), g AS (SELECT *, count(*) FILTER (WHERE before IS NULL OR ts - before >= INTERVAL 6 HOURS) OVER (PARTITION BY user_id
    ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id AS room, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s""")
def t10(spark: SparkSession, d: str) -> DataFrame:
    r = domain.readings(spark, d).withColumn("variable", F.lit("pir_count"))
    return sensors.presence_sessions(r, "6 hours", None).select("room", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("w09_route_overlaps", sql(""", p AS (SELECT user_id AS agent, event_id, ts, [event_id % 5, event_id % 7, event_id % 3] AS path
    FROM events), l AS (SELECT *, lag(path) OVER (PARTITION BY agent ORDER BY event_id) AS before FROM p) SELECT agent, event_id,
    CASE WHEN before IS NOT NULL THEN round(len(list_intersect(list_distinct(path), list_distinct(before))) / len(list_distinct(list_concat(path,
    before)))::DOUBLE, 6) END AS overlap FROM l""", "nodes"))
def w09(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    p = table(spark, d, "events").select(F.col("user_id").alias("agent"), "event_id", F.array(e % 5, e % 7, e % 3).alias("path"))
    return windows.jaccard_with_previous(p, "agent", "event_id", "path").select("agent", "event_id", F.round("overlap", 6).alias("overlap"))


@query("w10_m09_stuck", """SELECT room, event_id, moved FROM (SELECT user_id AS room, event_id, round(sqrt((event_id % 3 * 0.05 - lag(event_id % 3 *
    0.05, 19) OVER w) ** 2 + (user_id % 2 * 0.01 - lag(user_id % 2 * 0.01, 19) OVER w) ** 2), 6)::DOUBLE AS moved
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE moved < 0.06""")
def w10(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").select(F.col("user_id").alias("room"), "event_id", (F.col("event_id") % 3 * 0.05).alias("x"), (F.col("user_id") % 2 * 0.01).alias("y"))
    return windows.stuck(p, "room", "event_id", 20, 0.06).select("room", "event_id", F.round("moved", 6).alias("moved"))


@query("a26_run_totals", sql("""SELECT agent, count(*) AS frames, count(*) FILTER (WHERE event = 'RECALCULO') AS replans, round(sum(value), 6) AS
    travelled, round(avg(value), 6) AS mean, max(value) AS longest FROM log GROUP BY 1""", "log"))
def a26(spark: SparkSession, d: str) -> DataFrame:
    log = domain.event_log(spark, d)
    return aggregates.run_totals(log.select("agent", (F.col("event") == "RECALCULO").alias("replan"), F.col("value").alias("length")), "agent")


@query("a06_document_counts", sql(f""", {TOUCH} SELECT (SELECT count(*) FROM plan) AS cells, (SELECT count(*)
    FROM touch) AS boundaries, (SELECT count(DISTINCT category) FROM plan) AS categories""", "plan"))
def a06(spark: SparkSession, d: str) -> DataFrame:
    """How many members of each kind the model has, counted as rows."""
    cells, bounds = model(spark, d)
    return aggregates.member_counts(cells=cells, boundaries=bounds, categories=cells.select("category").distinct())


@query("o02_existence_probes", """SELECT n_nationkey AS nation, EXISTS (SELECT 1 FROM supplier
    WHERE s_nationkey = n_nationkey AND s_acctbal < 0 LIMIT 1) AS found FROM nation""")
def o02(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"))
    low = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("nation")).distinct().withColumn("found", F.lit(True))
    return n.join(low, "nation", "left").select("nation", F.coalesce("found", F.lit(False)).alias("found"))


@query("o05_parts_in_order", sql("SELECT cell, row_number() OVER (ORDER BY round(y0 / 3.0, 1), round(x0 / 3.0, 1), -w * h, cell) AS n FROM cells", "cells"))
def o05(spark: SparkSession, d: str) -> DataFrame:
    c = domain.cells(spark, d).select("cell", F.round(F.col("y0") / 3.0, 1).alias("low"), F.round(F.col("x0") / 3.0, 1).alias("left"), (-F.col("w") * F.col("h")).alias("size"))
    return windows.global_row_number(c, "low", "left", "size", "cell").select("cell", "n")


@query("o09_q11_overlap_warnings", sql(""", o AS (SELECT a.cell AS a, b.cell AS b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) *
    greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area FROM cells a JOIN cells b ON a.level = b.level AND a.cell < b.cell), s AS (SELECT a
    AS cell, b AS other, area FROM o WHERE area > 0 UNION ALL SELECT b, a, area FROM o WHERE area > 0) SELECT cell, other, area
    FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY area DESC, other) AS rn FROM s) WHERE rn <= 2""", "cells"))
def o09(spark: SparkSession, d: str) -> DataFrame:
    return dq.warnings_by_cell(topology.overlaps(domain.cells(spark, d)), 2)


@query("o10_first_errors", sql("SELECT 'cells/' || cell_id AS path, 'size ' || (w * h) AS message FROM cells WHERE w * h > 90 ORDER BY 1, 2 LIMIT 50", "cells"))
def o10(spark: SparkSession, d: str) -> DataFrame:
    c = domain.cells(spark, d).where("w * h > 90").select(F.concat(F.lit("cells/"), "cell_id").alias("path"), F.concat(F.lit("size "), (F.col("w") * F.col("h")).cast("string")).alias("message"))
    return dq.first_errors(c, 50)


@query("o12_largest_shells", sql("""SELECT level, size, cell, kind FROM (SELECT level, w * h AS size, cell, kind, row_number() OVER (PARTITION BY
    level ORDER BY w * h DESC, cell) AS rn FROM cells) WHERE rn = 1""", "cells"))
def o12(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.largest(domain.cells(spark, d).select("level", (F.col("w") * F.col("h")).alias("size"), "cell", "kind"), "level", "size", "cell")


@query("u01_u03_u08_unions", sql("""SELECT 'exit' AS part, node FROM nodes WHERE is_exit OR upper(function_code) IN ('EXIT', 'EMERGENCY_EXIT') UNION
    SELECT 'exit', node FROM nodes WHERE upper(function_code) IN ('WINDOW', 'VENTANA') UNION ALL SELECT 'level ' || level, node FROM nodes""", "nodes"))
def u01(spark: SparkSession, d: str) -> DataFrame:
    """Exits and windows as one set, and the documents of all levels one after another."""
    n = domain.nodes(spark, d)
    out = n.where(filters.is_exit()).select("node").union(n.where(filters.is_last_resort()).select("node")).distinct().select(F.lit("exit").alias("part"), "node")
    for level in range(5):
        out = out.unionByName(n.where(F.col("level") == level).select(F.lit(f"level {level}").alias("part"), "node"))
    return out


@query("u05_u09_kinds_of_levels", sql("""SELECT level, list_sort(list_distinct(list(kind))) AS kinds, list_sort(list_distinct(list_concat(list(kind),
    list(function_code)))) AS together FROM cells GROUP BY 1""", "cells"))
def u05(spark: SparkSession, d: str) -> DataFrame:
    c = domain.cells(spark, d).groupBy("level").agg(F.collect_set("kind").alias("kinds"), F.collect_set("function_code").alias("codes"))
    return c.select("level", F.array_sort("kinds").alias("kinds"), F.array_sort(F.array_distinct(F.concat("kinds", "codes"))).alias("together"))


@query("q02_ring_faults", sql("""SELECT cell, CASE WHEN cell % 5 = 0 THEN 'too few points' WHEN cell % 5 = 1 THEN 'open' WHEN cell % 5 = 2 THEN
    'no area' END AS fault FROM cells""", "cells"))
def q02(spark: SparkSession, d: str) -> DataFrame:
    """Rings cut short, left open, or flattened by the cell's number, and what is found wrong."""
    r = G.rect()
    whole = G.ring(r)
    flat = G.ring({**r, "y1": r["y0"]})
    k = F.col("cell") % 5
    ring = F.when(k == 0, F.slice(whole, 1, 3)).when(k == 1, F.slice(whole, 1, 4)).when(k == 2, flat).otherwise(whole)
    return domain.cells(spark, d).select("cell", dq.ring_faults(ring).alias("fault"))


def database(spark: SparkSession, d: str, kept: bool = False) -> dict[str, DataFrame]:
    """The relations of the indoor database over the floor plan, some of their rows at fault; contacts are worked out once if ``kept``."""
    p = domain.plan(spark, d)
    t = topology.contacts(p).select("a", "b")
    t = stored(t) if kept else t
    k = F.col("cell")
    bound = F.concat_ws("-", F.lit("CB"), F.col("a").cast("string"), F.col("b").cast("string"))
    node = lambda c: F.concat(F.lit("ND-"), F.col(c).cast("string"))
    cell = lambda c: F.concat(F.lit("CS-"), F.col(c).cast("string"))
    return {
        "theme_layer": spark.createDataFrame([("TH-01",)], "id_theme string"),
        "primal_space_layer": spark.createDataFrame([("PR-01", "TH-01"), ("PR-02", "TH-09")], "id_primal string, id_theme_layer string"),
        "dual_space_layer": spark.createDataFrame([("DU-01", "TH-01", False), ("DU-02", "TH-01", True)], "id_dual string, id_theme_layer string, is_logical boolean"),
        "cell_space": p.where("cell % 41 <> 0").select(cell("cell").alias("id_cell_space"), F.when(k % 37 == 0, "PR-07").otherwise("PR-01").alias("id_primal_space_layer")),
        "cell_boundary": t.where("(a + b) % 43 <> 0").select(bound.alias("id_cell_boundary"), F.when(F.col("a") % 47 == 0, "PR-08").otherwise("PR-01").alias("id_primal_space_layer"), F.when(F.col("a") % 53 == 0, "same").otherwise(bound).alias("boundary_key")),
        "cellspace_cellboundary": t.select(F.explode(F.array("a", "b")).alias("c"), bound.alias("id_cell_boundary")).select(cell("c").alias("id_cell_space"), "id_cell_boundary"),
        "node": p.select(node("cell").alias("id_node"), F.when(k % 59 == 0, "DU-05").otherwise("DU-01").alias("id_dual"), cell("cell").alias("id_cell_space")),
        "edge": t.select(F.lit("DU-01").alias("id_dual"), bound.alias("id_cell_boundary"), node("a").alias("from_node"), F.when(F.col("b") % 61 == 0, "ND-x").otherwise(node("b")).alias("to_node"), node("a").alias("low_node"), node("b").alias("high_node")),
        "navigable_space": p.select(cell("cell").alias("id_cell_space"), F.when(k % 67 == 0, "NOTHING").when(k % 2 == 0, "ROOM").otherwise("DOOR").alias("function_code")),
        "nav_space_function": spark.createDataFrame([("ROOM",), ("DOOR",)], "code string"),
    }


DATABASE = f"""{TOUCH}, id AS (SELECT name, cell FROM plan), t AS (SELECT least(a.cell, b.cell) AS a, greatest(a.cell, b.cell) AS b FROM touch JOIN id a ON a.name = via JOIN id b ON b.name = room),
cs AS (SELECT 'CS-' || cell AS id, CASE WHEN cell % 37 = 0 THEN 'PR-07' ELSE 'PR-01' END AS pr FROM plan WHERE cell % 41 <> 0), cb AS (SELECT 'CB-' || a || '-' || b AS id, CASE WHEN a % 47 = 0 THEN 'PR-08' ELSE 'PR-01' END AS pr, CASE WHEN a % 53 = 0 THEN 'same' ELSE 'CB-' || a || '-' || b END AS key FROM t WHERE (a + b) % 43 <> 0)"""


@query("q06_foreign_keys", sql(f""", {DATABASE} SELECT 'primal_space_layer.id_theme_layer' AS rule, 'TH-09' AS key UNION ALL SELECT DISTINCT 'cell_space.id_primal_space_layer', pr FROM cs WHERE pr <> 'PR-01' UNION ALL SELECT DISTINCT 'cell_boundary.id_primal_space_layer', pr FROM cb WHERE pr <> 'PR-01'
    UNION ALL SELECT DISTINCT 'cellspace_cellboundary.id_cell_space', 'CS-' || c FROM (SELECT a AS c FROM t UNION ALL SELECT b FROM t) WHERE c % 41 = 0 UNION ALL SELECT DISTINCT 'cellspace_cellboundary.id_cell_boundary', 'CB-' || a || '-' || b FROM t WHERE (a + b) % 43 = 0
    UNION ALL SELECT DISTINCT 'node.id_dual', 'DU-05' FROM plan WHERE cell % 59 = 0 UNION ALL SELECT 'node.id_cell_space', 'CS-' || cell FROM plan WHERE cell % 41 = 0 UNION ALL SELECT DISTINCT 'edge.id_cell_boundary', 'CB-' || a || '-' || b FROM t WHERE (a + b) % 43 = 0
    UNION ALL SELECT DISTINCT 'edge.to_node', 'ND-x' FROM t WHERE b % 61 = 0 UNION ALL SELECT 'navigable_space.id_cell_space', 'CS-' || cell FROM plan WHERE cell % 41 = 0 UNION ALL SELECT DISTINCT 'navigable_space.function_code', 'NOTHING' FROM plan WHERE cell % 67 = 0""", "plan"))  # fmt: skip
def q06(spark: SparkSession, d: str) -> DataFrame:
    return dq.foreign_keys(database(spark, d, kept=True), schemas.FOREIGN_KEYS)


@query("q05_unique_keys", sql(f""", {DATABASE} SELECT 'dual_space_layer(id_theme_layer)' AS rule, 'TH-01' AS key UNION ALL
    SELECT 'cell_boundary(boundary_key)', key FROM cb GROUP BY key HAVING count(*) > 1""", "plan"))
def q05(spark: SparkSession, d: str) -> DataFrame:
    return dq.unique_keys(database(spark, d, kept=True), schemas.UNIQUE_KEYS)


@query("q14_themes", "SELECT * FROM (VALUES ('DU-01', 'PR-02'), ('DU-09', 'PR-01')) t(id_dual, id_primal)")
def q14(spark: SparkSession, d: str) -> DataFrame:
    db = database(spark, d)
    pairs = spark.createDataFrame([("DU-01", "PR-01"), ("DU-01", "PR-02"), ("DU-02", "PR-01"), ("DU-09", "PR-01")], "id_dual string, id_primal string")
    return dq.same_theme(db["dual_space_layer"], db["primal_space_layer"], pairs)


@query("q07_nodes_in_cells", sql("SELECT 'N' || cell AS id_node, cell AS id_cell FROM plan WHERE cell % 4 <> 3 AND cell % 9 IN (0, 1)", "plan"))
def q07(spark: SparkSession, d: str) -> DataFrame:
    """Nodes in the middle of their cells, some of them pushed out; those of a logical dual may lie anywhere."""
    p = domain.plan(spark, d)
    out = F.when(F.col("cell") % 9 == 0, 50).when(F.col("cell") % 9 == 1, -30).otherwise(0)
    nodes = p.select(F.concat(F.lit("N"), F.col("cell").cast("string")).alias("id_node"), F.when(F.col("cell") % 4 == 3, "DU-02").otherwise("DU-01").alias("id_dual"), F.col("cell").alias("id_cell"), ((F.col("x0") + F.col("x1")) / 2 + out).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    return dq.nodes_outside(nodes, p.withColumnRenamed("cell", "id_cell"), database(spark, d)["dual_space_layer"])


@query("q13_tile_chains", """WITH t AS (SELECT l_orderkey AS chain, l_linenumber AS pos, l_linenumber +
    CASE WHEN l_linenumber >= 4 AND l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS x, 0 AS y FROM lineitem UNION ALL
    SELECT l_orderkey, l_linenumber + 10, 1, 1 FROM lineitem WHERE l_linenumber = 1), s AS (SELECT *, count(*) OVER (PARTITION BY chain, x, y) AS
    seen, abs(x - lag(x) OVER w) + abs(y - lag(y) OVER w) AS step FROM t WINDOW w AS (PARTITION BY chain ORDER BY pos)) SELECT chain, pos,
    CASE WHEN seen > 1 THEN 'repeated' ELSE 'gap' END AS fault FROM s WHERE seen > 1 OR step <> 1""")
def q13(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chain"), F.col("l_linenumber").alias("pos"))
    jump = F.when((F.col("pos") >= 4) & (F.col("chain") % 3 == 0), 1).otherwise(0)
    tiles = line.select("chain", "pos", (F.col("pos") + jump).alias("x"), F.lit(0).alias("y")).union(line.where("pos = 1").select("chain", F.col("pos") + 10, F.lit(1), F.lit(1)))
    return dq.chain_faults(tiles)


@query("m07_m10_walked_frames", sql("""SELECT u * 100 + v AS agent, leg, frame, round(ax + (bx - ax) * frame / 25.0, 6) AS x, round(ay + (yb - ay) *
    frame / 25.0, 6) AS y FROM (SELECT u, v, weight AS leg, a.x::DOUBLE AS ax, a.y::DOUBLE AS ay, b.x::DOUBLE AS bx, b.y::DOUBLE AS yb FROM edges
    JOIN nodes a ON u = a.node JOIN nodes b ON v = b.node), range(0, 25) r(frame)""", "edges", "nodes"))
def m07(spark: SparkSession, d: str) -> DataFrame:
    from .columns import lines

    legs = lines(spark, d).select((F.col("u") * 100 + F.col("v")).alias("agent"), F.col("weight").alias("leg"), *[F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")])
    return sim.walked(legs).select("agent", "leg", F.col("frame").cast("bigint").alias("frame"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("m03_m05_evacuated", sql("""SELECT p.node AS agent, min(t) AS t FROM nodes p, range(0, 40) r(t), nodes e
    WHERE e.is_exit AND sqrt((p.x + t - e.x) ** 2 + (p.y - e.y) ** 2) <= 2.0 GROUP BY 1""", "nodes"))
def m03(spark: SparkSession, d: str) -> DataFrame:
    """Everybody walks east a metre a step; the step that brings them within two metres of an exit."""
    n = domain.nodes(spark, d)
    at = n.select(F.col("node").alias("agent"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(39).cast("bigint"))).alias("t"), "x", "y").withColumn("x", F.col("x") + F.col("t"))
    return sim.evacuated(at, n.where("is_exit").select("x", "y"))


@query("m01_m11_activation_order", "SELECT count(*) AS agents, count(*) AS places FROM supplier")
def m01(spark: SparkSession, d: str) -> DataFrame:
    """A crowd of as many as there are suppliers, in a random order of activation: everybody once."""
    walls = spark.createDataFrame([(0.0, 0.0, 60.0, 30.0)], "x0 double, y0 double, x1 double, y1 double")
    crowd = sim.population(spark, table(spark, d, "supplier").count(), 60.0, 40.0, walls)
    return sim.activation(crowd, step=3).where("y > 30").agg(F.count(F.lit(1)).alias("agents"), F.countDistinct("place").alias("places"))


@query("m06_m09_discrete_ticks", """WITH RECURSIVE legs AS (SELECT c_custkey AS agent, CAST(i AS INTEGER) AS leg, least((c_nationkey + i) % 25, (c_nationkey + i + 1) % 25) AS eu, greatest((c_nationkey + i) % 25, (c_nationkey + i + 1) % 25) AS ev, 5.0::DOUBLE + (c_nationkey + i) % 4 AS length FROM customer, range(0, 3) r(i) WHERE c_custkey % 7 <> 0),
    r(now, agent, leg, spent, status, t) AS (SELECT 0, c_custkey, 0, 0.0::DOUBLE, CASE WHEN c_custkey % 7 = 0 THEN 'stuck' ELSE 'moving' END, 0 FROM customer
    UNION ALL SELECT now + 1, agent, CASE WHEN over AND leg < 2 THEN leg + 1 ELSE leg END, CASE WHEN over THEN 0.0 WHEN status = 'moving' THEN spent + 2.0 ELSE spent END, CASE WHEN over AND leg = 2 THEN 'done' ELSE status END, CASE WHEN over AND leg = 2 THEN now + 1 ELSE t END
    FROM (SELECT r.*, status = 'moving' AND spent + 2.0 >= length / 1.2 * (1 + 0.6 * greatest(0, n - 3) / 3) AS over FROM r LEFT JOIN legs USING (agent, leg) LEFT JOIN (SELECT eu, ev, count(*) AS n FROM r JOIN legs USING (agent, leg) WHERE status = 'moving' GROUP BY 1, 2) USING (eu, ev)) WHERE now < 12)
    SELECT agent, leg, status, t FROM r WHERE now = 12""")
def m06(spark: SparkSession, d: str) -> DataFrame:
    """Customers walk three edges each, slowed by who is on the same edge; a seventh of them have no route."""
    c = table(spark, d, "customer")
    k = F.col("c_nationkey") + F.col("leg")
    legs = c.where("c_custkey % 7 <> 0").withColumn("leg", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(F.col("c_custkey").alias("agent"), "leg", (k % 25).alias("u"), ((k + 1) % 25).alias("v"), (5.0 + k % 4).alias("length"))
    return sim.discrete(c.select(F.col("c_custkey").alias("agent")), legs, 12, tick=2.0)


@query("j21_connector_cells", sql("SELECT 'C' || (cell // 3) AS endpoint, name AS cell FROM plan WHERE category IN ('Stair', 'Ramp') AND name LIKE '%EAST%'", "plan"))
def j21(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints of connectors joined to their cells by the id that follows from level, side and number."""
    p = domain.plan(spark, d)
    k = F.floor(F.col("cell") / 3)
    ends = p.where("category in ('Stair', 'Ramp') and name like '%EAST%'").select(F.concat(F.lit("C"), k.cast("string")).alias("endpoint"), ids.numbered("CS_L00_EAST_", k, 6).alias("name"))
    return ends.join(p.select("name"), "name").select("endpoint", F.col("name").alias("cell"))


@query("g43_walkable_places", sql(""", p AS (SELECT s_suppkey AS place, s_suppkey * 13 % 560 - 30 AS x, s_suppkey * 5 % 60 AS y FROM supplier) SELECT place, x BETWEEN 0 AND 500 AND y BETWEEN 0 AND 50 AND NOT EXISTS (SELECT 1 FROM plan
    WHERE category = 'Window' AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) AS walkable FROM p""", "plan"))
def g43(spark: SparkSession, d: str) -> DataFrame:
    """Places on the canvas that no window takes."""
    k = F.col("s_suppkey")
    p = table(spark, d, "supplier").select(k.alias("place"), (k * 13 % 560 - 30).alias("x"), (k * 5 % 60).alias("y"))
    windows_ = domain.plan(spark, d).where("category = 'Window'").select("x0", "y0", "x1", "y1")
    cut = joins.tiles(windows_, 20.0, G.rect())
    at = p.withColumn("tx", F.floor(F.col("x") / 20.0)).withColumn("ty", F.floor(F.col("y") / 20.0))
    taken = at.join(cut, ["tx", "ty"]).where("x between x0 and x1 and y between y0 and y1").select("place").distinct().withColumn("taken", F.lit(True))
    inside = (F.col("x").between(0, 500)) & (F.col("y").between(0, 50))
    return p.join(taken, "place", "left").select("place", (inside & F.col("taken").isNull()).alias("walkable"))
