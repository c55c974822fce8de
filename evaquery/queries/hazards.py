"""Routes, scores over time and sensor rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import filters
from ..plans import cep, graph, routing, scores
from ..registry import query
from ..sources import domain
from ..sources.domain import sql
from ..sources.storage import stored

SYM = "sym AS (SELECT u, v, weight FROM edges UNION ALL SELECT v, u, weight FROM edges)"
#: Costs from every source: the frontier keeps one least cost a (source, node) and step.
REACH = """r(source, node, cost) USING KEY (source, node) AS (SELECT node, node, 0 FROM nodes UNION SELECT source, node, min(cost) FROM (SELECT r.source, s.v AS node, r.cost + s.weight AS cost FROM r JOIN sym s ON r.node = s.u
 LEFT JOIN recurring.r o ON o.source = r.source AND o.node = s.v WHERE o.cost IS NULL OR r.cost + s.weight < o.cost) GROUP BY 1, 2)"""


def every(spark: SparkSession, d: str) -> DataFrame:
    return graph.distances(domain.edges(spark, d), domain.nodes(spark, d).select("node"))


@query("r01_components", sql(f""", link AS (SELECT u, v FROM edges), bi AS (SELECT u, v FROM link UNION ALL SELECT v, u
    FROM link), r(node, root) AS (SELECT node, node FROM nodes UNION SELECT b.v, r.root FROM r JOIN bi b ON r.node = b.u)
    SELECT node, min(root) AS root FROM r GROUP BY node""", "nodes", "edges", recursive=True))
def r01(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(domain.nodes(spark, d).select("node"), domain.edges(spark, d))


@query("r02_shortest_costs", sql(f", {SYM}, {REACH} SELECT source, node, CAST(cost AS DOUBLE) AS cost FROM r", "nodes", "edges", recursive=True))
def r02(spark: SparkSession, d: str) -> DataFrame:
    return every(spark, d).select("source", "node", "cost")


@query("r05_r06_best_exit", sql(f""", {SYM}, {REACH} SELECT source, arg_min(node, cost * 1000 + node) AS target, CAST(min(cost) AS DOUBLE) AS cost
    FROM r WHERE node IN (7, 19) GROUP BY source""", "nodes", "edges", recursive=True))
def r05(spark: SparkSession, d: str) -> DataFrame:
    n = domain.nodes(spark, d)
    return graph.with_fallback(domain.edges(spark, d), n, n.where(filters.is_exit()), n.where(filters.is_last_resort()))


@query("r09_route_costs", sql(f", {SYM}, {REACH} SELECT source, node AS target, CAST(cost AS DOUBLE) AS cost FROM r WHERE node <> source", "nodes", "edges", recursive=True))
def r09(spark: SparkSession, d: str) -> DataFrame:
    e = domain.edges(spark, d)
    costs = graph.distances(e, domain.nodes(spark, d))
    routes = graph.paths(costs, costs.where("node <> source").select("source", F.col("node").alias("target")))
    return graph.route_costs(routes, e).select("source", "target", F.col("cost").cast("double").alias("cost"))


#: Costs and legs from one node of the large graph, fewest legs on ties.
LARGE = """both_ways AS (SELECT u, v, weight FROM stock UNION ALL SELECT v, u, weight FROM stock), depot AS (SELECT min(v) AS node FROM stock),
 r(node, cost, legs) USING KEY (node) AS (SELECT node, 0.0::DOUBLE, 0 FROM depot UNION SELECT node, b.cost, b.legs FROM (SELECT s.v AS node, min({'cost': r.cost + s.weight, 'legs': r.legs + 1}) AS b FROM r JOIN both_ways s ON r.node = s.u
 LEFT JOIN recurring.r o ON o.node = s.v WHERE o.cost IS NULL OR r.cost + s.weight < o.cost OR (r.cost + s.weight = o.cost AND r.legs + 1 < o.legs) GROUP BY 1))"""


def from_depot(spark: SparkSession, d: str) -> DataFrame:
    e = domain.stock(spark, d)
    return graph.distances(e, e.agg(F.min("v").alias("node")))


@query("r01_components_large", sql(""", both_ways AS (SELECT u, v FROM stock UNION ALL SELECT v, u FROM stock), r(node, root) USING KEY (node) AS (SELECT node, node FROM stock_nodes UNION SELECT s.v, min(r.root) FROM r JOIN both_ways s ON r.node = s.u JOIN recurring.r o ON o.node = s.v WHERE r.root < o.root GROUP BY 1)
    SELECT node, root FROM r""", "stock", "stock_nodes", recursive=True))  # fmt: skip
def r01_large(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(domain.stock_nodes(spark, d), domain.stock(spark, d))


@query("r02_r08_costs_large", sql(f""", {LARGE} SELECT r.node, any_value(r.cost) AS cost, min(s.u) AS previous FROM r LEFT JOIN (both_ways s
    JOIN r p ON p.node = s.u) ON s.v = r.node AND p.cost + s.weight = r.cost AND p.legs + 1 = r.legs GROUP BY r.node""", "stock", recursive=True))
def r02_large(spark: SparkSession, d: str) -> DataFrame:
    return from_depot(spark, d).select("node", "cost", "previous")


@query("r09_routes_large", sql(f", {LARGE} SELECT node AS target, cost, CAST(legs AS INTEGER) AS legs FROM r WHERE legs > 0", "stock", recursive=True))
def r09_large(spark: SparkSession, d: str) -> DataFrame:
    """Every route from the depot, walked back and its weights summed along it."""
    costs = from_depot(spark, d)
    routes = graph.paths(costs, costs.where("node <> source").select("source", F.col("node").alias("target")))
    summed = graph.route_costs(routes, domain.stock(spark, d))
    return summed.join(routes.select("target", (F.size("path") - 1).alias("legs")), "target").select("target", "cost", "legs")


@query("r05_nearest_goal_large", sql(""", both_ways AS (SELECT u, v, weight FROM stock UNION ALL SELECT v, u, weight FROM stock), goal AS (SELECT 2 * p_partkey + 1 AS node FROM part WHERE p_partkey % 97 = 0),
 r(node, cost, target) USING KEY (node) AS (SELECT node, 0.0::DOUBLE, node FROM goal UNION SELECT node, b.cost, b.target FROM (SELECT s.v AS node, min({'cost': r.cost + s.weight, 'target': r.target}) AS b FROM r JOIN both_ways s ON r.node = s.u
 LEFT JOIN recurring.r o ON o.node = s.v WHERE o.cost IS NULL OR r.cost + s.weight < o.cost OR (r.cost + s.weight = o.cost AND r.target < o.target) GROUP BY 1)) SELECT node, target, cost FROM r""", "stock", recursive=True))  # fmt: skip
def r05_large(spark: SparkSession, d: str) -> DataFrame:
    return graph.reach(domain.stock(spark, d), domain.cells(spark, d).where("is_exit").select((2 * F.col("cell") + 1).alias("node")))


@query("r03_r04_kernel_routes", sql(f""", {SYM}, {REACH} SELECT g AS grp, source AS start, node AS goal, CAST(cost AS DOUBLE) AS cost
    FROM r, (VALUES ('dijkstra'), ('astar'), ('yen_ksp')) t(g) WHERE node IN (7, 19)""", "nodes", "edges", recursive=True))
def r03(spark: SparkSession, d: str) -> DataFrame:
    e, asked, out = domain.edges(spark, d), to_exits(spark, d), None
    for name, search in routing.ALGORITHMS.items():
        made = search(e, asked).join(asked, "q").select(F.lit(name).alias("grp"), "start", "goal", "cost")
        out = made if out is None else out.unionByName(made)
    return out


def to_exits(spark: SparkSession, d: str) -> DataFrame:
    """(q, start, goal): a query from every node to each of the two exits."""
    n = domain.nodes(spark, d).select(F.col("node").cast("long").alias("start"))
    return n.select((F.col("start") * 100).alias("base"), "start", F.explode(F.array(F.lit(7), F.lit(19)).cast("array<bigint>")).alias("goal")).select((F.col("base") + F.col("goal")).alias("q"), "start", "goal")


#: Loopless routes to an exit, a row a route, while they can still cost no more than ``most``: by the costs of REACH, which count back from the exits too.
def routes_up_to(most: str) -> str:
    return f"""least AS (SELECT source AS goal, node, cost FROM r WHERE source IN (7, 19)), ways(start, goal, path, node, cost, most) AS (SELECT node, goal, [node], node, 0, {most} FROM least
 UNION ALL SELECT start, w.goal, list_append(path, s.v), s.v, w.cost + s.weight, most FROM ways w JOIN sym s ON w.node = s.u JOIN least l ON l.goal = w.goal AND l.node = s.v
 WHERE w.node <> w.goal AND NOT list_contains(path, s.v) AND w.cost + s.weight + l.cost <= most),
 found AS (SELECT start, goal, path, cost FROM ways WHERE node = goal),
 uses AS (SELECT start, goal, path, cost, i, path[i] AS a, path[i + 1] AS b, [least(path[i], path[i + 1]), greatest(path[i], path[i + 1])] AS e FROM found, range(1, 26) t(i) WHERE i < len(path)),
 main AS (SELECT start, goal, min(cost) AS cost, (min({{'c': cost, 'p': path}})).p AS path FROM found GROUP BY 1, 2)"""


#: The cheapest found route of each main route without each of its edges, within the tolerance.
ONE = """one AS (SELECT m.start, m.goal, m.cost AS least, u.i AS leg, u.e AS lost, min({'c': f.cost, 'p': f.path}) AS b FROM main m JOIN uses u ON u.start = m.start AND u.goal = m.goal AND u.path = m.path
 JOIN found f ON f.start = m.start AND f.goal = m.goal AND NOT EXISTS (SELECT 1 FROM range(1, 26) t(i) WHERE i < len(f.path) AND least(f.path[i], f.path[i + 1]) = u.e[1] AND greatest(f.path[i], f.path[i + 1]) = u.e[2])
 WHERE f.cost <= 1.5 * m.cost GROUP BY 1, 2, 3, 4, 5)"""


@query("r04_k_routes", sql(f""", {SYM}, {REACH}, {routes_up_to('cost + 10')} SELECT start, goal, CAST(rank AS INTEGER) AS rank, CAST(cost AS DOUBLE) AS cost, list_transform(path, lambda x: CAST(x AS BIGINT)) AS path
    FROM (SELECT *, row_number() OVER (PARTITION BY start, goal ORDER BY cost, path) AS rank FROM found) WHERE rank <= 5""", "nodes", "edges", recursive=True))  # fmt: skip
def r04(spark: SparkSession, d: str) -> DataFrame:
    """The five cheapest loopless routes of every node to each exit."""
    asked = to_exits(spark, d)
    return routing.k_routes(domain.edges(spark, d), asked, 5).join(asked, "q").select("start", "goal", "rank", "cost", "path")


@query("r10_r12_resilience", sql(f""", {SYM}, {REACH}, {routes_up_to('1.5 * cost')}, {ONE},
    two AS (SELECT o.start, o.goal, o.leg, g.i, min({{'c': f.cost, 'p': f.path}}) AS b FROM one o, range(1, 26) g(i), found f WHERE g.i < len(o.b.p) AND f.start = o.start AND f.goal = o.goal AND NOT EXISTS (SELECT 1 FROM range(1, 26) t(i) WHERE t.i < len(f.path)
    AND [least(f.path[t.i], f.path[t.i + 1]), greatest(f.path[t.i], f.path[t.i + 1])] IN (o.lost, [least(o.b.p[g.i], o.b.p[g.i + 1]), greatest(o.b.p[g.i], o.b.p[g.i + 1])])) GROUP BY 1, 2, 3, 4)
    SELECT m.start, m.goal, CAST(m.cost AS DOUBLE) AS cost, (SELECT count(*) FROM one o WHERE o.start = m.start AND o.goal = m.goal) AS level1, (SELECT count(DISTINCT b.p) FROM one o WHERE o.start = m.start AND o.goal = m.goal) AS distinct1,
    (SELECT count(*) FROM two o WHERE o.start = m.start AND o.goal = m.goal) AS level2, (SELECT count(DISTINCT b.p) FROM two o WHERE o.start = m.start AND o.goal = m.goal) AS distinct2 FROM main m""", "nodes", "edges", recursive=True))  # fmt: skip
def r10(spark: SparkSession, d: str) -> DataFrame:
    """Evacuation centrality of every node towards each exit: alternatives after the loss of one edge, and of two."""
    asked = to_exits(spark, d)
    got = routing.evacuation_centrality(domain.edges(spark, d), asked)
    return got.join(asked, "q").select("start", "goal", "cost", "level1", "distinct1", "level2", "distinct2")


@query("r11_robust_to_exits", sql(f""", {SYM}, {REACH}, {routes_up_to('1.44 * cost + 0.001')},
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start, goal ORDER BY cost, path) AS rk, min(cost) OVER (PARTITION BY start, goal) AS least FROM found) WHERE rk <= 3 AND cost <= 1.2 * least),
    again AS (SELECT n.start, n.goal, n.path, u.i FROM near n JOIN uses u ON u.start = n.start AND u.goal = n.goal AND u.path = n.path JOIN found f ON f.start = n.start AND f.goal = n.goal AND f.cost <= 1.2 * n.cost
    AND NOT EXISTS (SELECT 1 FROM range(1, 26) t(i) WHERE t.i < len(f.path) AND least(f.path[t.i], f.path[t.i + 1]) = u.e[1] AND greatest(f.path[t.i], f.path[t.i + 1]) = u.e[2]) GROUP BY 1, 2, 3, 4),
    rated AS (SELECT n.start, n.goal, n.path, n.cost, (SELECT count(*) FROM again a WHERE a.start = n.start AND a.goal = n.goal AND a.path = n.path) AS robustness FROM near n)
    SELECT start, goal, CAST(cost AS DOUBLE) AS cost, robustness, list_transform(path, lambda x: CAST(x AS BIGINT)) AS path FROM (SELECT *, row_number() OVER (PARTITION BY start, goal ORDER BY robustness DESC, cost, path) AS rn FROM rated) WHERE rn = 1""", "nodes", "edges", recursive=True))  # fmt: skip
def r11(spark: SparkSession, d: str) -> DataFrame:
    """Of the three cheapest routes to each exit within a fifth more, the one that stands the loss of most of its edges."""
    asked = to_exits(spark, d)
    return routing.most_robust(domain.edges(spark, d), asked, tolerance=0.2).join(asked, "q").select("start", "goal", "cost", "robustness", "path")


@query("r14_betweenness_all_nodes", sql(f""", {SYM}, {REACH}, walk(source, node) AS (SELECT node, node FROM nodes UNION ALL SELECT w.source, s.v FROM walk w JOIN sym s ON s.u = w.node JOIN r a ON a.source = w.source AND a.node = w.node JOIN r b ON b.source = w.source AND b.node = s.v WHERE a.cost + s.weight = b.cost),
    ways AS (SELECT source, node, count(*) AS n FROM walk GROUP BY 1, 2), full_ AS (SELECT source, node, cost, n FROM r JOIN ways USING (source, node))
    SELECT CAST(m.node AS BIGINT) AS node, round(coalesce((SELECT sum(a.n * b.n / c.n) FROM full_ a JOIN full_ b ON b.source = a.node JOIN full_ c ON c.source = a.source AND c.node = b.node WHERE a.node = m.node AND a.source <> m.node AND b.node <> m.node AND a.source <> b.node AND a.cost + b.cost = c.cost), 0), 6) AS score
    FROM (SELECT DISTINCT u AS node FROM sym) m""", "nodes", "edges", recursive=True))  # fmt: skip
def r14(spark: SparkSession, d: str) -> DataFrame:
    """Betweenness with every node as a source; the SQL counts it by the closed form."""
    return routing.betweenness(domain.edges(spark, d), domain.nodes(spark, d).select("node")).select("node", F.round("score", 6).alias("score"))


@query("r14_betweenness_large", sql(f""", {LARGE},
    walk(id, path, node) AS (SELECT node, [node], node FROM depot UNION ALL SELECT s.v, list_append(w.path, s.v), s.v FROM walk w JOIN both_ways s ON s.u = w.node JOIN r a ON a.node = s.u JOIN r b ON b.node = s.v WHERE a.cost + s.weight = b.cost),
    ways AS (SELECT node, count(*) AS n FROM walk GROUP BY 1), passed AS (SELECT unnest(path[2:len(path) - 1]) AS node, 1.0::DOUBLE / n AS share FROM walk JOIN ways USING (node))
    SELECT m.node, round(coalesce(s, 0.0::DOUBLE), 6) AS score FROM (SELECT DISTINCT u AS node FROM both_ways) m LEFT JOIN (SELECT node, sum(share) AS s FROM passed GROUP BY 1) p USING (node)""", "stock", recursive=True))  # fmt: skip
def r14_large(spark: SparkSession, d: str) -> DataFrame:
    """The shares of cheapest routes from one pivot that pass each node of the large graph; the SQL lists every such route."""
    e = domain.stock(spark, d)
    return routing.betweenness(e, e.agg(F.min("v").alias("node"))).select("node", F.round("score", 6).alias("score"))


@query("r03_landmark_routes", sql(f""", {LARGE} SELECT node AS goal, cost, true AS fewer FROM r WHERE node % 2 = 1 AND node % 331 = 0""", "stock", recursive=True))
def r03_landmarks(spark: SparkSession, d: str) -> DataFrame:
    """From the depot to some parts by a search that four landmarks keep narrow: the costs, and whether it touched fewer nodes than there are."""
    e = stored(domain.stock(spark, d))
    goals = e.where("v % 331 = 0").select(F.col("v").alias("goal")).distinct()
    asked = goals.join(e.agg(F.min("v").alias("start")), how="cross").select(F.col("goal").alias("q"), "start", "goal")  # one start
    found = routing.point_to_point(e, asked, routing.landmarks(e, 4))
    n = e.select(F.col("u").alias("node")).union(e.select("v")).distinct().count()
    return found.select("goal", "cost", (F.col("touched") < n).alias("fewer"))


@query("r21_disjoint_to_exits", sql(f""", {SYM}, deg AS (SELECT u AS node, count(*) AS n FROM sym GROUP BY 1) SELECT a.node AS start, b.node AS goal, least(a.n, b.n) AS routes FROM deg a, deg b WHERE b.node IN (7, 19) AND a.node <> b.node""", "nodes", "edges"))
def r21(spark: SparkSession, d: str) -> DataFrame:
    """Routes to each exit that share no edge. The SQL has the least degree of both ends, which is the most there can
    be and, in so dense a graph, what routes of one and two legs already make."""
    asked = to_exits(spark, d)
    return routing.disjoint_routes(domain.edges(spark, d), asked).join(asked, "q").select("start", "goal", "routes")


@query("r17_fire_penalty", sql(""", m AS (SELECT u, v, weight, (a.x + b.x) / 2.0 AS x, (a.y + b.y) / 2.0 AS y FROM edges JOIN nodes a ON u = a.node
    JOIN nodes b ON v = b.node) SELECT u, v, CAST(weight + 5000 * (SELECT count(*) FROM nodes f
    WHERE f.node % 6 = 1 AND sqrt((f.x - m.x) ** 2 + (f.y - m.y) ** 2) <= 5.0) AS DOUBLE) AS weight FROM m""", "nodes", "edges"))
def r17(spark: SparkSession, d: str) -> DataFrame:
    n = domain.nodes(spark, d)
    at = lambda k: n.select(F.col("node").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    e = domain.edges(spark, d).join(at("u"), "u").join(at("v"), "v").select("u", "v", "weight", ((F.col("ux") + F.col("vx")) / 2.0).alias("x"), ((F.col("uy") + F.col("vy")) / 2.0).alias("y"))
    return graph.fire_weights(e, n.where("node % 6 = 1"))


@query("r19_reachable", sql(f""", {SYM}, r(source, node) AS (SELECT node, node FROM nodes UNION SELECT r.source, s.v FROM r
    JOIN sym s ON r.node = s.u) SELECT source, count(*) AS n FROM r GROUP BY source""", "nodes", "edges", recursive=True))
def r19(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(domain.nodes(spark, d).select("node"), domain.edges(spark, d)).select(F.col("node").alias("source"), "n")


@query("t01_scores_over_time", sql(""", w AS (SELECT node, 10.0 + node AS start, 12.0 AS dur, 0.5 AS low FROM nodes UNION ALL SELECT node, 15.0, 10.0, 0.2 FROM nodes WHERE node % 2 = 0), t AS (SELECT node, t * 4.0 AS t FROM nodes, range(0, 9) r(t)),
    v AS (SELECT t.node, t.t, min(CASE WHEN (t.t - start) / dur <= 0.5 THEN 1 + (low - 1) * ((t.t - start) / dur * 2) ELSE low + (1 - low) * ((t.t - start) / dur * 2 - 1) END) AS s FROM t JOIN w ON w.node = t.node AND t.t BETWEEN start AND start + dur GROUP BY 1, 2)
    SELECT t.node, CAST(t.t AS DOUBLE) AS t, round(least(greatest(coalesce(v.s, 1.0), 0.0), 1.0), 6) AS score FROM t LEFT JOIN v ON v.node = t.node AND v.t = t.t""", "nodes"))  # fmt: skip
def t01(spark: SparkSession, d: str) -> DataFrame:
    n = domain.nodes(spark, d)
    tri = lambda df, start, dur, low: df.select("node", F.lit("triangle").alias("kind"), start.cast("double").alias("start"), F.lit(dur).alias("dur"), F.lit(low).alias("v1"), F.lit(1.0).alias("v2"), F.lit(0).alias("ordinal"))
    spans = tri(n, 10.0 + F.col("node"), 12.0, 0.5).unionByName(tri(n.where("node % 2 = 0"), F.lit(15.0), 10.0, 0.2))
    times = n.select("node", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k")).select("node", (F.col("k") * 4.0).alias("t"))
    return scores.at_times(times, spans).select("node", "t", F.round("score", 6).alias("score"))


@query("t02_radial_fire", sql("SELECT node, round(10.0 + sqrt((x - 20) ** 2 + (y - 20) ** 2) * 0.8, 6) AS start FROM nodes", "nodes"))
def t02(spark: SparkSession, d: str) -> DataFrame:
    n = domain.nodes(spark, d)
    return scores.radial_fire(n, n.where("node = 12")).select("node", F.round("start", 6).alias("start"))


@query("t03_linear_front", sql("SELECT node, round(10.0 + greatest(0.0, ((x - 0) * 40 + (y - 0) * 40) / 3200.0) * 0.8 * sqrt(3200.0), 6) AS start FROM nodes", "nodes"))
def t03(spark: SparkSession, d: str) -> DataFrame:
    n = domain.nodes(spark, d)
    return scores.linear_front(n, (0.0, 0.0), (40.0, 40.0)).select("node", F.round("start", 6).alias("start"))


@query("t04_phases", sql(""", p AS (SELECT node, node // 5 AS phase FROM nodes) SELECT node, 'ramp' AS kind, 5.0 + phase * 6.0 AS start, 6.0 AS dur,
    0.5 AS v1, 0 AS ordinal FROM p UNION ALL SELECT node, 'hold', 5.0 + phase * 6.0 + 6.0, 12.0, 0.5, 1 FROM p UNION ALL
    SELECT node, 'ramp', 5.0 + phase * 6.0 + 18.0, 8.0, 1.0, 2 FROM p""", "nodes"))
def t04(spark: SparkSession, d: str) -> DataFrame:
    return scores.phases(domain.nodes(spark, d).select("node", F.floor(F.col("node") / 5).alias("phase")), "ramp_hold").select("node", "kind", "start", "dur", "v1", "ordinal")


@query("t09_tumbling_states", sql("""SELECT room, time_bucket(INTERVAL 6 HOURS, ts) AS w, count(*) AS n, round(avg(value), 6) AS mean FROM readings
    GROUP BY 1, 2""", "readings"))
def t09(spark: SparkSession, d: str) -> DataFrame:
    w = F.window("ts", "6 hours")
    return domain.readings(spark, d).groupBy("room", w.alias("win")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).select("room", F.col("win.start").cast("timestamp_ntz").alias("w"), "n", "mean")


@query("t08_sliding_medians", sql("""SELECT room, w, round(median(value), 6) AS med
    FROM (SELECT room, value, time_bucket(INTERVAL 3 HOURS, ts) - k * INTERVAL 3 HOURS AS w FROM readings, range(0, 2) r(k)) GROUP BY 1, 2""", "readings"))
def t08(spark: SparkSession, d: str) -> DataFrame:
    w = F.window("ts", "6 hours", "3 hours")
    return domain.readings(spark, d).groupBy("room", w.alias("win")).agg(F.round(F.median("value"), 6).alias("med")).select("room", F.col("win.start").cast("timestamp_ntz").alias("w"), "med")


@query("f23_f25_room_states", sql(""", m AS (SELECT room, coalesce(avg(value) FILTER (WHERE variable = 'view'), 0) * 80 AS co2, coalesce(avg(value) FILTER (WHERE variable = 'click'), 0) * 30 AS tvoc, coalesce(avg(value) FILTER (WHERE variable = 'purchase'), 0) AS temp,
     coalesce(avg(value) FILTER (WHERE variable = 'error'), 0) AS hum FROM readings GROUP BY room),
    s AS (SELECT *, CASE WHEN co2 > 5000 THEN 3 WHEN co2 > 2000 THEN 2 WHEN co2 >= 1000 THEN 1 ELSE 0 END AS sc, CASE WHEN tvoc > 3000 THEN 3 WHEN tvoc > 1000 THEN 2 WHEN tvoc >= 500 THEN 1 ELSE 0 END AS sv,
     least(3, CASE WHEN temp >= 60 THEN 3 WHEN temp >= 50 THEN 2 ELSE 0 END + CASE WHEN temp > 30 AND hum > 70 THEN 1 ELSE 0 END) AS st FROM m)
    SELECT room, sc AS sev_co2, sv AS sev_tvoc, st AS sev_temp, (st >= 2 AND sv >= 1) AS fire, (sv >= 2 AND sc >= 1) AS leak, CASE WHEN (st >= 2 AND sv >= 1) OR (sv >= 2 AND sc >= 1) THEN 3 ELSE greatest(sc, sv, st) END AS severity,
    round(CASE WHEN st >= 2 AND sv >= 1 THEN 1.0 ELSE 1 - (1 - 0.25 * (['0', '0.33', '0.66', '1'])[sc + 1]::DOUBLE) * (1 - 0.25 * (['0', '0.33', '0.66', '1'])[sv + 1]::DOUBLE) * (1 - 0.35 * (['0', '0.33', '0.66', '1'])[st + 1]::DOUBLE) END, 6) AS risk FROM s""", "readings"))  # fmt: skip
def f23(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda v, k: F.coalesce(F.avg(F.when(F.col("variable") == v, F.col("value"))), F.lit(0.0)) * k
    m = domain.readings(spark, d).groupBy("room").agg(mean("view", 80).alias("co2"), mean("click", 30).alias("tvoc"), mean("purchase", 1).alias("temp"), mean("error", 1).alias("hum"))
    return cep.room_states(m).select("room", "sev_co2", "sev_tvoc", "sev_temp", "fire", "leak", "severity", F.round("risk", 6).alias("risk"))


@query("f25_hazard_weights", sql(""", s AS (SELECT node, 1 - coalesce(score, 1.0) AS r FROM nodes)
    SELECT u, v, round(CASE WHEN greatest(a.r, b.r) >= 0.85 OR weight / 1.2 / 60 > 0.2 THEN NULL ELSE weight * (1 + 3 * greatest(a.r, b.r)) END, 6) AS
    weight FROM edges JOIN s a ON u = a.node JOIN s b ON v = b.node""", "nodes", "edges"))
def f25(spark: SparkSession, d: str) -> DataFrame:
    s = domain.nodes(spark, d).select("node", (1 - F.coalesce("score", F.lit(1.0))).alias("r"))
    e = domain.edges(spark, d).join(s.select(F.col("node").alias("u"), F.col("r").alias("ru")), "u").join(s.select(F.col("node").alias("v"), F.col("r").alias("rv")), "v")
    return e.select("u", "v", F.round(scalars.hazard_weight(F.col("weight"), F.greatest("ru", "rv"), F.col("weight") / 1.2 / 60, F.lit(0.2)), 6).alias("weight"))


@query("t13_current_readings", sql("""SELECT room, variable, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY room, variable
    ORDER BY ts DESC, event_id DESC) AS rn FROM readings) WHERE rn = 1""", "readings"))
def t13(spark: SparkSession, d: str) -> DataFrame:
    r = domain.readings(spark, d).select("room", "variable", "ts", "event_id", "value")
    return cep.upserted(r.where("event_id % 2 = 0"), r.where("event_id % 2 = 1")).select("room", "variable", "event_id", "value")


@query("t19_hazard_growth", sql("""SELECT node, t, least(2.0 + 1.5 * t, 12.0) AS radius, count(*) FILTER (WHERE inside) AS nodes_inside
    FROM (SELECT f.node, k AS t, sqrt((n.x - f.x) ** 2 + (n.y - f.y) ** 2) <= least(2.0 + 1.5 * k, 12.0) AS inside
    FROM nodes f, nodes n, range(0, 10) r(k) WHERE f.node % 8 = 0) GROUP BY 1, 2""", "nodes"))
def t19(spark: SparkSession, d: str) -> DataFrame:
    n = domain.nodes(spark, d).select("node", "x", "y")
    return scores.growing_hazards(n.where("node % 8 = 0"), n, 2.0, 1.5, 12.0, 10).select("node", "t", "radius", "nodes_inside")
