"""Scans, filters, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators import aggregates, filters, joins, windows
from ..registry import query
from ..sources import domain
from ..sources.domain import sql, table

WALKERS = ("WALK", "RAMP")
MOVES = "(coalesce(locomotion IN ('WALK','RAMP'), false) OR (locomotion IS NULL AND kind = 'GENERAL'))"


@query(
    "slice1_masked_graph_summary",
    sql(f""", ok AS (SELECT node, level FROM nodes WHERE {MOVES} AND coalesce(score, 1.0) >= 0.3), kept AS (SELECT e.u, e.v, e.weight, a.level FROM edges e JOIN ok a ON e.u = a.node JOIN ok b ON e.v = b.node WHERE e.weight > 0)
    SELECT n.level, n.n_nodes, coalesce(k.n_edges, 0) AS n_edges, coalesce(k.total, 0) AS total_weight FROM (SELECT level, count(*) AS n_nodes FROM ok GROUP BY 1) n
    LEFT JOIN (SELECT level, count(*) AS n_edges, CAST(sum(weight) AS BIGINT) AS total FROM kept GROUP BY 1) k USING (level)""", "nodes", "edges"),
)
def slice1(spark: SparkSession, d: str) -> DataFrame:
    ok = domain.nodes(spark, d).where(filters.mobility_allowed(WALKERS) & filters.safe(0.3)).select("node", "level")
    kept = filters.induced(filters.positive(domain.edges(spark, d)), ok).join(ok.withColumnRenamed("node", "u"), "u")
    per = kept.groupBy("level").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("total"))
    return ok.groupBy("level").agg(F.count(F.lit(1)).alias("n_nodes")).join(per, "level", "left").select("level", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("total", F.lit(0)).alias("total_weight"))


@query("s06_node_scan", sql("SELECT node, level, x, y, locomotion, kind, function_code, is_exit FROM nodes WHERE level = 2 ORDER BY node", "nodes"))
def s06(spark: SparkSession, d: str) -> DataFrame:
    return filters.optional_equal(domain.nodes(spark, d), level=2, kind=None).select("node", "level", "x", "y", "locomotion", "kind", "function_code", "is_exit").orderBy("node")


@query("s07_edge_scan_by_level", sql("""SELECT e.u, e.v, e.weight, a.level FROM edges e JOIN nodes a ON e.u = a.node JOIN nodes b ON e.v = b.node
    WHERE a.level = b.level""", "nodes", "edges"))
def s07(spark: SparkSession, d: str) -> DataFrame:
    n = domain.nodes(spark, d)
    a, b = n.select(F.col("node").alias("u"), "level"), n.select(F.col("node").alias("v"), F.col("level").alias("lb"))
    return domain.edges(spark, d).join(a, "u").join(b, "v").where("level = lb").select("u", "v", "weight", "level")


@query("s08_latest_score", sql("""SELECT room, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY room
    ORDER BY ts DESC, event_id DESC) AS rn FROM readings) WHERE rn = 1""", "readings"))
def s08(spark: SparkSession, d: str) -> DataFrame:
    return windows.latest(domain.readings(spark, d).select("room", "ts", "event_id", "value"), ["room"], "ts", "event_id").select("room", "event_id", "value")


@query("s09_exit_nodes", sql("SELECT node FROM nodes WHERE is_exit OR upper(function_code) IN ('EXIT', 'EMERGENCY_EXIT')", "nodes"))
def s09(spark: SparkSession, d: str) -> DataFrame:
    return domain.nodes(spark, d).where(filters.is_exit()).select("node")


@query("s27_function_catalogue", "SELECT * FROM (VALUES " + ", ".join(map(str, schemas.NAVIGATION_FUNCTIONS)) + ") t(code, label, kind, default_locomotion)")
def s27(spark: SparkSession, d: str) -> DataFrame:
    seed = schemas.navigation_functions(spark)
    return seed.unionByName(seed).dropDuplicates(["code"])


@query("p02_mobility_mask", sql("""SELECT node, (coalesce(locomotion IN ('WALK','RAMP'), false) OR (locomotion IS NULL AND kind = 'GENERAL')) AS
    lenient, coalesce(locomotion IN ('WALK','RAMP'), false) AS strict FROM nodes""", "nodes"))
def p02(spark: SparkSession, d: str) -> DataFrame:
    return domain.nodes(spark, d).select("node", filters.mobility_allowed(WALKERS).alias("lenient"), filters.mobility_allowed(WALKERS, False).alias("strict"))


@query("p04_safety_mask", sql("SELECT node, coalesce(score, 1.0) >= 0.6 AS walk, coalesce(score, 1.0) >= 0.75 AS roll FROM nodes", "nodes"))
def p04(spark: SparkSession, d: str) -> DataFrame:
    return domain.nodes(spark, d).select("node", filters.safe(0.6).alias("walk"), filters.safe(0.75).alias("roll"))


@query("p06_last_resort", sql("SELECT node FROM nodes WHERE upper(function_code) IN ('WINDOW', 'VENTANA')", "nodes"))
def p06(spark: SparkSession, d: str) -> DataFrame:
    return domain.nodes(spark, d).where(filters.is_last_resort()).select("node")


@query("p08_induced_edges", sql("""SELECT u, v, weight FROM edges WHERE u IN (SELECT node FROM nodes WHERE kind = 'GENERAL') AND v IN (SELECT node
    FROM nodes WHERE kind = 'GENERAL')""", "nodes", "edges"))
def p08(spark: SparkSession, d: str) -> DataFrame:
    return filters.induced(domain.edges(spark, d), domain.nodes(spark, d).where("kind = 'GENERAL'"))


@query("p09_matrix_mask", sql("SELECT u AS i, v AS j, CASE WHEN u % 4 <> 0 AND v % 4 <> 0 THEN weight ELSE 0 END AS w FROM edges", "edges"))
def p09(spark: SparkSession, d: str) -> DataFrame:
    return filters.masked_matrix(domain.edges(spark, d).select(F.col("u").alias("i"), F.col("v").alias("j"), F.col("weight").alias("w")), domain.nodes(spark, d).where("node % 4 <> 0"))


@query("p10_safety_cut", sql("SELECT u AS i, v AS j, CASE WHEN ((u + v) % 10) / 10.0 < 0.5 THEN 0 ELSE weight END AS cost FROM edges", "edges"))
def p10(spark: SparkSession, d: str) -> DataFrame:
    e = domain.edges(spark, d).select(F.col("u").alias("i"), F.col("v").alias("j"), F.col("weight").alias("cost"))
    return filters.safety_cut(e, e.select("i", "j", ((F.col("i") + F.col("j")) % 10 / 10.0).alias("safety")), 0.5)


@query("p11_banned_nodes", sql("SELECT u, v, weight FROM edges WHERE u % 7 <> 3 AND v % 7 <> 3 AND (u + v) % 25 % 7 <> 3", "edges"))
def p11(spark: SparkSession, d: str) -> DataFrame:
    n = domain.nodes(spark, d).select("node", F.when(F.col("node") % 7 == 3, F.array(F.lit("Walking"))).otherwise(F.array(F.lit("Walking"), F.lit("Rolling"))).alias("locomotion_list"))
    e = domain.edges(spark, d).withColumn("context", (F.col("u") + F.col("v")) % 25)
    return filters.without_banned(e, n).select("u", "v", "weight")


@query("p12_named_exits", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a')")
def p12(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.lower("p_name").contains("a")).select("p_partkey", "p_name")


@query("p22_navigation_view", sql("SELECT c.cell_id, c.level, c.kind, f.label FROM cells c LEFT JOIN (VALUES " + ", ".join(map(str, schemas.NAVIGATION_FUNCTIONS)) + ") f(code, label, kind, loc) ON c.function_code = f.code", "cells"))
def p22(spark: SparkSession, d: str) -> DataFrame:
    f = schemas.navigation_functions(spark).select(F.col("code").alias("function_code"), "label")
    return domain.cells(spark, d).join(F.broadcast(f), "function_code", "left").select("cell_id", "level", "kind", "label")


@query("p24_closed_doors", sql(""", st AS (SELECT u, v, arg_max(CASE WHEN weight % 2 = 0 THEN 'closed' ELSE 'open' END, weight) AS state FROM edges
    GROUP BY 1, 2) SELECT u, v, weight FROM edges JOIN st USING (u, v) WHERE state <> 'closed'""", "edges"))
def p24(spark: SparkSession, d: str) -> DataFrame:
    e = domain.edges(spark, d)
    return filters.without_closed(e, e.select("u", "v", F.col("weight").alias("ts"), F.when(F.col("weight") % 2 == 0, "closed").otherwise("open").alias("state"))).select("u", "v", "weight")


@query("p25_general_walks", sql("SELECT cell_id, CASE WHEN kind = 'GENERAL' AND locomotion IS NULL THEN 'WALK' ELSE locomotion END AS locomotion FROM cells", "cells"))
def p25(spark: SparkSession, d: str) -> DataFrame:
    return domain.cells(spark, d).select("cell_id", F.when((F.col("kind") == "GENERAL") & F.col("locomotion").isNull(), "WALK").otherwise(F.col("locomotion")).alias("locomotion"))


@query("p28_forced_sources", sql(f"""SELECT node, ({MOVES} AND coalesce(score, 1.0) >= 0.6) OR node < 4 AS kept,
    CASE WHEN NOT {MOVES} THEN 'mobility' WHEN coalesce(score, 1.0) < 0.6 THEN 'score' END AS reason FROM nodes""", "nodes"))
def p28(spark: SparkSession, d: str) -> DataFrame:
    n = domain.nodes(spark, d)
    return filters.forced(n, n.where("node < 4"), WALKERS, 0.6)


@query("j03_anti_join", sql("SELECT node FROM nodes WHERE node NOT IN (SELECT u FROM edges)", "nodes", "edges"))
def j03(spark: SparkSession, d: str) -> DataFrame:
    return domain.nodes(spark, d).join(domain.edges(spark, d).select(F.col("u").alias("node")), "node", "left_anti").select("node")


@query("j05_semi_join", sql("SELECT node FROM nodes WHERE node IN (SELECT v FROM edges)", "nodes", "edges"))
def j05(spark: SparkSession, d: str) -> DataFrame:
    return domain.nodes(spark, d).join(domain.edges(spark, d).select(F.col("v").alias("node")), "node", "left_semi").select("node")


@query("j09_pairs_in_room", sql("SELECT level, a.node AS a, b.node AS b FROM nodes a JOIN nodes b USING (level) WHERE a.node < b.node", "nodes"))
def j09(spark: SparkSession, d: str) -> DataFrame:
    return joins.pairs_in_group(domain.nodes(spark, d), "level", "node")


@query("j13_nearest_node", sql("""SELECT cell, node, d2 FROM (SELECT c.cell, n.node, (c.x0 / 10.0 - n.x) * (c.x0 / 10.0 - n.x) + (c.y0 / 10.0 - n.y) * (c.y0 / 10.0 - n.y) AS d2,
    row_number() OVER (PARTITION BY c.cell ORDER BY (c.x0 / 10.0 - n.x) * (c.x0 / 10.0 - n.x) + (c.y0 / 10.0 - n.y) * (c.y0 / 10.0 - n.y), n.node) AS rk FROM cells c, nodes n WHERE n.is_exit) WHERE rk = 1""", "cells", "nodes"))  # fmt: skip
def j13(spark: SparkSession, d: str) -> DataFrame:
    c = domain.cells(spark, d).select("cell", (F.col("x0") / 10.0).alias("x"), (F.col("y0") / 10.0).alias("y"))
    return joins.nearest(c, domain.nodes(spark, d).where("is_exit"), "cell", "node")


@query("j19_full_outer_counts", sql("""SELECT coalesce(a.agent, b.agent) AS agent, coalesce(a.n, 0) AS routes, coalesce(b.n, 0) AS replans FROM (SELECT agent, count(*) AS n FROM log WHERE event = 'CAMBIO_RUTA' GROUP BY 1) a
    FULL JOIN (SELECT agent, count(*) AS n FROM log WHERE event = 'RECALCULO' GROUP BY 1) b ON a.agent = b.agent""", "log"))  # fmt: skip
def j19(spark: SparkSession, d: str) -> DataFrame:
    log = domain.event_log(spark, d)
    count = lambda event, name: log.where(F.col("event") == event).groupBy("agent").agg(F.count(F.lit(1)).alias(name))
    return count("CAMBIO_RUTA", "routes").join(count("RECALCULO", "replans"), "agent", "full").na.fill(0)


@query("j24_score_windows", sql(""", sp AS (SELECT node, node * 2.0 AS start, 15.0 AS dur FROM nodes), ti AS (SELECT node, t * 10.0 AS t
    FROM nodes, range(0, 6) r(t)) SELECT node, CAST(t AS DOUBLE) AS t, CAST(start AS DOUBLE) AS start FROM ti JOIN sp USING (node)
    WHERE t BETWEEN start AND start + dur""", "nodes"))
def j24(spark: SparkSession, d: str) -> DataFrame:
    n = domain.nodes(spark, d)
    spans = n.select("node", (F.col("node") * 2.0).alias("start"), F.lit(15.0).alias("dur"))
    times = n.select("node", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("t")).select("node", (F.col("t") * 10.0).alias("t"))
    return joins.in_interval(times, spans, "node").select("node", "t", "start")


@query("j25_last_known_value", sql(""", r AS (SELECT room, ts, event_id, value FROM readings
    WHERE variable = 'view'), l AS (SELECT room, ts, event_id FROM readings WHERE variable = 'purchase') SELECT l.event_id, (SELECT max(r.value)
    FROM r WHERE r.room = l.room AND r.ts = (SELECT max(r2.ts) FROM r r2 WHERE r2.room = l.room AND r2.ts <= l.ts)) AS value FROM l""", "readings"))
def j25(spark: SparkSession, d: str) -> DataFrame:
    r = domain.readings(spark, d)
    state = r.where("variable = 'view'").groupBy("room", "ts").agg(F.max("value").alias("value"))
    return joins.as_of(r.where("variable = 'purchase'").select("room", "ts", "event_id"), state, "room", "value").select("event_id", "value")


@query("a07_count_avg_by_room", sql("SELECT room, count(*) AS n, round(avg(value), 2) AS mean FROM readings GROUP BY room", "readings"))
def a07(spark: SparkSession, d: str) -> DataFrame:
    return domain.readings(spark, d).groupBy("room").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 2).alias("mean"))


@query("a08_alert_status", sql("""SELECT room, variable, max(ts) AS last_ts, CASE WHEN max(value) > 95 THEN 'ALERTA' WHEN max(value) > 80 THEN
    'AVISO' ELSE 'NORMAL' END AS status FROM readings GROUP BY 1, 2""", "readings"))
def a08(spark: SparkSession, d: str) -> DataFrame:
    return domain.readings(spark, d).groupBy("room", "variable").agg(F.max("ts").alias("last_ts"), F.when(F.max("value") > 95, "ALERTA").when(F.max("value") > 80, "AVISO").otherwise("NORMAL").alias("status"))


@query("a09_events_by_agent", sql("""SELECT agent, count(*) FILTER (WHERE event = 'CAMBIO_RUTA') AS routes, count(*) FILTER (WHERE event =
    'RECALCULO') AS replans, count(*) FILTER (WHERE event = 'EVACUACION_COMPLETA') AS evacuated FROM log GROUP BY agent""", "log"))
def a09(spark: SparkSession, d: str) -> DataFrame:
    n = lambda e, name: F.count_if(F.col("event") == e).alias(name)
    return domain.event_log(spark, d).groupBy("agent").agg(n("CAMBIO_RUTA", "routes"), n("RECALCULO", "replans"), n("EVACUACION_COMPLETA", "evacuated"))


@query("a10_evacuation_means", sql("""SELECT count(*) AS n, round(avg(step), 4) AS mean_step, min(step) AS first_step, max(step) AS last_step
    FROM log WHERE event = 'EVACUACION_COMPLETA'""", "log"))
def a10(spark: SparkSession, d: str) -> DataFrame:
    return domain.event_log(spark, d).where("event = 'EVACUACION_COMPLETA'").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("step"), 4).alias("mean_step"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


@query("a11_graph_summary", sql("""SELECT n.n_nodes, m.n_edges, m.min_w, m.max_w, m.mean_w, round(2 * m.n_edges / (n.n_nodes * (n.n_nodes - 1)), 6)
    AS density, round(2 * m.n_edges / n.n_nodes, 6) AS mean_degree FROM (SELECT count(*) AS n_nodes
    FROM nodes) n, (SELECT count(*) AS n_edges, min(weight) AS min_w, max(weight) AS max_w, round(avg(weight), 6) AS mean_w FROM edges) m""", "nodes", "edges"))
def a11(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.graph_summary(domain.nodes(spark, d), domain.edges(spark, d))


@query("a12_safe_count_by_step", sql("SELECT step, count(*) FILTER (WHERE value >= 50) AS safe, count(*) AS n FROM log GROUP BY step", "log"))
def a12(spark: SparkSession, d: str) -> DataFrame:
    return domain.event_log(spark, d).groupBy("step").agg(F.count_if(F.col("value") >= 50).alias("safe"), F.count(F.lit(1)).alias("n"))


@query("a15_edge_occupancy", """SELECT least(c_nationkey, s_nationkey) AS u, greatest(c_nationkey, s_nationkey) AS v, count(*) AS n FROM customer
    JOIN supplier ON c_custkey % 100 = s_suppkey % 100 GROUP BY 1, 2""")
def a15(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    pair = c.join(s, c.c_custkey % 100 == s.s_suppkey % 100)
    return pair.groupBy(F.least("c_nationkey", "s_nationkey").alias("u"), F.greatest("c_nationkey", "s_nationkey").alias("v")).agg(F.count(F.lit(1)).alias("n"))


@query("a17_melted_counts", sql(""", c AS (SELECT agent, count(*) FILTER (WHERE event = 'CAMBIO_RUTA') AS routes, count(*) FILTER (WHERE event =
    'RECALCULO') AS replans FROM log GROUP BY agent) SELECT agent, 'routes' AS measure, routes AS value FROM c UNION ALL
    SELECT agent, 'replans', replans FROM c""", "log"))
def a17(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.melted(a09(spark, d).select("agent", "routes", "replans"), ["agent"], ["routes", "replans"])


@query("a18_step_histogram", sql("SELECT CAST(least(floor(step / 48.0), 14) AS INTEGER) AS bin, count(*) AS n FROM log WHERE step BETWEEN 0 AND 720 GROUP BY 1", "log"))
def a18(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.histogram(domain.event_log(spark, d), "step", 0, 720, 15)


@query("a19_density_grid", sql("""SELECT CAST(floor(x0 / 50.0) AS INTEGER) AS gx, CAST(floor(y0 / 50.0) AS INTEGER) AS gy, count(*) AS n FROM cells
    GROUP BY 1, 2""", "cells"))
def a19(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.density(domain.cells(spark, d).select(F.col("x0").alias("x"), F.col("y0").alias("y")), 50.0)


@query("a21_noisy_or_risk", sql("""SELECT room, round(1 - product(1 - 0.25 * CASE WHEN value > 75 THEN 1.0 WHEN value > 50 THEN 0.66 WHEN value > 25
    THEN 0.33 ELSE 0.0 END), 6) AS risk FROM (SELECT room, variable, avg(value) AS value FROM readings GROUP BY 1, 2) GROUP BY room""", "readings"))
def a21(spark: SparkSession, d: str) -> DataFrame:
    mean = domain.readings(spark, d).groupBy("room", "variable").agg(aggregates.steady_mean(F.col("value")).alias("value"))
    s = F.when(F.col("value") > 75, 1.0).when(F.col("value") > 50, 0.66).when(F.col("value") > 25, 0.33).otherwise(0.0)
    return mean.groupBy("room").agg(F.round(aggregates.noisy_or(F.lit(0.25), s), 6).alias("risk"))


@query("a24_median_p75", sql("SELECT room, round(median(value), 6) AS med, round(quantile_cont(value, 0.75), 6) AS p75 FROM readings GROUP BY room", "readings"))
def a24(spark: SparkSession, d: str) -> DataFrame:
    return domain.readings(spark, d).groupBy("room").agg(F.round(F.median("value"), 6).alias("med"), F.round(F.percentile("value", 0.75), 6).alias("p75"))


@query("w01_mean_of_last_three", sql("""SELECT room, variable, round(avg(value), 6) AS mean, count(*) AS rows_used
    FROM (SELECT *, row_number() OVER (PARTITION BY room, variable ORDER BY ts DESC, event_id DESC) AS rn FROM readings) WHERE rn <= 3 GROUP BY 1, 2""", "readings"))
def w01(spark: SparkSession, d: str) -> DataFrame:
    return windows.mean_of_last(domain.readings(spark, d), ["room", "variable"], "ts", "event_id", "value")


@query("w03_cumulative_evacuated", sql("""SELECT step, n, CAST(sum(n) OVER (ORDER BY step) AS BIGINT) AS total FROM (SELECT step, count(*) AS n
    FROM log WHERE event = 'EVACUACION_COMPLETA' GROUP BY step)""", "log"))
def w03(spark: SparkSession, d: str) -> DataFrame:
    return windows.cumulative(domain.event_log(spark, d).where("event = 'EVACUACION_COMPLETA'"), "step")


@query("w05_ema", sql("""SELECT room, round(list_reduce(list_prepend(1.0::DOUBLE, list(value
    ORDER BY ts, value)), lambda a, b: a * (1 - 0.3::DOUBLE) + b * 0.3::DOUBLE), 6) AS ema, count(*) AS n FROM readings GROUP BY room""", "readings"))
def w05(spark: SparkSession, d: str) -> DataFrame:
    return windows.ema(domain.readings(spark, d), "room", "ts", "value").select("room", "ema", F.col("n").cast("bigint").alias("n"))


@query("w06_flips", sql(""", l AS (SELECT event_id, room, value / 100 AS value, coalesce(lag(value / 100) OVER (PARTITION BY room
    ORDER BY ts, event_id), 1.0) AS before FROM readings) SELECT event_id, room, round(abs(value - before), 6) AS delta FROM l
    WHERE ((before >= 0.6) <> (value >= 0.6)) OR round(abs(value - before), 6) >= 0.2""", "readings"))
def w06(spark: SparkSession, d: str) -> DataFrame:
    r = domain.readings(spark, d).select("event_id", "room", "ts", (F.col("value") / 100).alias("value"))
    return windows.flips(r, "room", ["ts", "event_id"], "value", 0.6, 0.2).select("event_id", "room", "delta")


@query("w07_route_changes", sql(""", l AS (SELECT event_id, agent, event, lag(event) OVER (PARTITION BY agent ORDER BY step, event_id) AS before
    FROM log) SELECT event_id, agent, event FROM l WHERE event IS DISTINCT FROM before""", "log"))
def w07(spark: SparkSession, d: str) -> DataFrame:
    return windows.changes(domain.event_log(spark, d), "agent", ["step", "event_id"], "event").select("event_id", "agent", "event")


@query("w11_pressure_jump", sql(""", l AS (SELECT event_id, room, max(value) OVER w - min(value) OVER w AS jump FROM readings
    WHERE variable = 'view' WINDOW w AS (PARTITION BY room ORDER BY ts RANGE BETWEEN INTERVAL 10 HOURS PRECEDING AND CURRENT ROW))
    SELECT event_id, room, round(jump, 6) AS jump FROM l WHERE jump > 50""", "readings"))
def w11(spark: SparkSession, d: str) -> DataFrame:
    r = domain.readings(spark, d).where("variable = 'view'")
    r.createOrReplaceTempView("view_readings")
    return spark.sql("""SELECT event_id, room, round(jump, 6) AS jump FROM (SELECT event_id, room, max(value) OVER w - min(value) OVER w AS jump
    FROM view_readings WINDOW w AS (PARTITION BY room ORDER BY ts RANGE BETWEEN INTERVAL 10 HOURS PRECEDING AND CURRENT ROW)) WHERE jump > 50""")


@query("w13_moving_average", sql("""SELECT event_id, room, round(avg(value) OVER (PARTITION BY room
    ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS ma FROM readings""", "readings"))
def w13(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("room").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return domain.readings(spark, d).select("event_id", "room", F.round(F.avg("value").over(by), 6).alias("ma"))


@query("w13_hysteresis", sql("""SELECT event_id, coalesce(last_value(CASE WHEN value >= 80 THEN true WHEN value < 60 THEN false END IGNORE NULLS)
    OVER (PARTITION BY room ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS active FROM readings""", "readings"))
def w13h(spark: SparkSession, d: str) -> DataFrame:
    r = domain.readings(spark, d).withColumn("at", F.struct("ts", "event_id"))
    return windows.hysteresis(r, "room", "at", "value", 80, 60).select("event_id", "active")


@query("w14_recent_history", sql("SELECT event_id, room FROM readings WHERE ts >= (SELECT max(ts) FROM readings) - INTERVAL 48 HOURS", "readings"))
def w14(spark: SparkSession, d: str) -> DataFrame:
    r = domain.readings(spark, d)
    now = r.agg(F.max("ts").alias("now"))
    return r.join(F.broadcast(now), F.col("ts") >= F.col("now") - F.expr("INTERVAL 48 HOURS")).select("event_id", "room")


@query("w16_type_counters", sql("""SELECT cell_id, 'SF_' || lpad(CAST(row_number() OVER (PARTITION BY level, function_code
    ORDER BY cell) AS VARCHAR), 6, '0') AS feature FROM cells""", "cells"))
def w16(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("level", "function_code").orderBy("cell"))
    return domain.cells(spark, d).select("cell_id", F.concat(F.lit("SF_"), F.lpad(n.cast("string"), 6, "0")).alias("feature"))


@query("w17_duplicate_suffix", sql(""", b AS (SELECT cell, function_code AS base, row_number() OVER (PARTITION BY function_code ORDER BY cell) AS n
    FROM cells) SELECT cell, CASE WHEN n = 1 THEN base WHEN n < 100 THEN base || '_' || lpad(CAST(n AS VARCHAR), 2, '0') ELSE base || '_' || CAST(n AS
    VARCHAR) END AS id FROM b""", "cells"))
def w17(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("function_code").orderBy("cell"))
    c = domain.cells(spark, d).withColumn("n", n)
    text = F.col("n").cast("string")
    return c.select("cell", F.when(F.col("n") == 1, F.col("function_code")).otherwise(F.concat("function_code", F.lit("_"), F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text))).alias("id"))


@query("o04_faces_by_area", sql("SELECT cell_id, (x1 - x0) * (y1 - y0) AS area FROM cells ORDER BY area DESC, y0, x0, cell_id LIMIT 50", "cells"))
def o04(spark: SparkSession, d: str) -> DataFrame:
    a = domain.cells(spark, d).withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return windows.top(a, 50, F.desc("area"), "y0", "x0", "cell_id").select("cell_id", "area")


@query("o07_top_changes", sql("""SELECT event_id, delta FROM (SELECT event_id, round(abs(value - coalesce(lag(value) OVER (PARTITION BY room
    ORDER BY ts, event_id), 1.0)), 6) AS delta FROM readings) ORDER BY delta DESC, event_id LIMIT 6""", "readings"))
def o07(spark: SparkSession, d: str) -> DataFrame:
    r = windows.flips(domain.readings(spark, d), "room", ["ts", "event_id"], "value", 0.0, 0.0)
    return windows.top(r, 6, F.desc("delta"), "event_id").select("event_id", "delta")


@query("u02_set_operations", sql(f""", m AS (SELECT node FROM nodes WHERE {MOVES}), s AS (SELECT node FROM nodes WHERE coalesce(score, 1.0) >= 0.6)
    SELECT 'both' AS kind, node FROM (SELECT node FROM m INTERSECT SELECT node FROM s) UNION ALL SELECT 'either', node FROM (SELECT node FROM m UNION
    SELECT node FROM s) UNION ALL SELECT 'only_mobile', node FROM (SELECT node FROM m EXCEPT SELECT node FROM s)""", "nodes"))
def u02(spark: SparkSession, d: str) -> DataFrame:
    n = domain.nodes(spark, d)
    m, s = n.where(filters.mobility_allowed(WALKERS)).select("node"), n.where(filters.safe(0.6)).select("node")
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "node")
    return named(m.intersect(s), "both").unionAll(named(m.union(s).distinct(), "either")).unionAll(named(m.exceptAll(s), "only_mobile"))


@query("x_rollup_levels", sql("SELECT level, kind, count(*) AS n FROM cells GROUP BY ROLLUP (level, kind)", "cells"))
def rollup(spark: SparkSession, d: str) -> DataFrame:
    return domain.cells(spark, d).rollup("level", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("t16_monthly_partitions", """SELECT CAST(year(l_shipdate) AS INTEGER) AS y, CAST(month(l_shipdate) AS INTEGER) AS m, count(*) AS n
    FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1, 2""")
def t16(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").where((F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")))
    return line.groupBy(F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m")).agg(F.count(F.lit(1)).alias("n"))
