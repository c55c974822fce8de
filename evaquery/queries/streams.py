"""Stream plans run over the driver's events as they would arrive: two files, one after another, read as a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins
from ..plans import legacy
from ..registry import query
from ..sources import domain
from ..sources.domain import sql
from ..sources.storage import shared_dir
from ..streaming import sensors
from .relations import asked


def streamed(spark: SparkSession, rows: DataFrame, build: Callable[[DataFrame], DataFrame], each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> DataFrame | None:
    """What a stream of ``rows`` (with a column ts) through ``build`` has written when it has read all.

    The first half in time arrives, in as many files as there are tasks, and is read; then
    the second, by the same query started again from its checkpoint. Results are appended
    to files, or each batch goes to ``each``; a complete result replaces the one before.
    """
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    half = rows.select(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()[0] or 0
    early = F.unix_micros(F.col("ts").cast("timestamp")) <= half
    put = each
    if each is None and mode == "complete":
        put = lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/out")
    for part in (early, ~early):
        rows.where(part).write.mode("append").parquet(f"{at}/in")
        made = build(spark.readStream.schema(rows.schema).parquet(f"{at}/in"))
        writer = made.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
        running = writer.foreachBatch(put).start() if put else writer.format("parquet").start(f"{at}/out")
        running.awaitTermination()
    return None if each else spark.read.schema(made.schema).parquet(f"{at}/out")


def arriving(spark: SparkSession, d: str) -> DataFrame:
    return domain.readings(spark, d).select("room", "variable", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


@query("t11_stream_hysteresis", sql(""", s AS (SELECT room, ts, value, last_value(CASE WHEN value >= 60 THEN true WHEN value < 20 THEN false END
    IGNORE NULLS) OVER (PARTITION BY room ORDER BY ts, value ROWS UNBOUNDED PRECEDING) AS a
    FROM readings), c AS (SELECT room, ts, coalesce(a, false) AS active, lag(coalesce(a, false), 1, false) OVER (PARTITION BY room
    ORDER BY ts, value) AS before FROM s) SELECT room, ts, active FROM c WHERE active <> before""", "readings"))
def t11(spark: SparkSession, d: str) -> DataFrame:
    rows = arriving(spark, d).withColumn("room", F.col("room").cast("string"))
    made = streamed(spark, rows, lambda s: sensors.hysteresis(s, 60.0, 20.0))
    return made.select(F.col("room").cast(domain.readings(spark, d).schema["room"].dataType).alias("room"), F.col("ts").cast("timestamp_ntz").alias("ts"), "active")


@query("t07_stream_throttle", sql(""", r(agent, ts) AS (SELECT room, min(ts) FROM readings GROUP BY 1 UNION ALL SELECT r.agent, min(e.ts) FROM r
    JOIN readings e ON e.room = r.agent AND e.ts >= r.ts + INTERVAL 24 HOURS GROUP BY r.agent, r.ts) SELECT agent, ts FROM r""", "readings", recursive=True))
def t07(spark: SparkSession, d: str) -> DataFrame:
    """Replan requests of an agent at least a day apart."""
    rows = arriving(spark, d).select(F.col("room").cast("string").alias("agent"), "ts")
    made = streamed(spark, rows, lambda s: sensors.throttled(s, 86400.0))
    return made.select(F.col("agent").cast(domain.readings(spark, d).schema["room"].dataType).alias("agent"), F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("t12_stream_tumbling", sql("""SELECT room, variable, time_bucket(INTERVAL 6 HOURS, ts) AS start, count(*) AS n, round(avg(value), 6) AS mean,
    max(value) AS most FROM readings GROUP BY 1, 2, 3""", "readings"))
def t12(spark: SparkSession, d: str) -> DataFrame:
    made = streamed(spark, arriving(spark, d), lambda s: sensors.tumbling_states(s, "6 hours", None), mode="complete")
    return made.select("room", "variable", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"), "most")


@query("t06_t17_stream_current", sql("""SELECT room, variable, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY room, variable
    ORDER BY ts DESC, event_id DESC) AS rn FROM readings) WHERE rn = 1""", "readings"))
def t17(spark: SparkSession, d: str) -> DataFrame:
    """The table of current readings, kept up batch by batch, as it is when all have arrived."""
    current = sensors.CurrentReadings(f"{shared_dir(spark)}/current-{uuid.uuid4().hex}")
    streamed(spark, arriving(spark, d), lambda s: s, each=current, mode="update")
    return current.read(spark).select("room", "variable", "event_id", "value")


@query("t21_locations_and_routes", sql(""", l AS (SELECT room AS agent, ts, event_id % 25 AS node
    FROM readings), h AS (SELECT agent, count(DISTINCT node) AS visited, max_by(node, ts) AS node FROM l GROUP BY 1)
    SELECT agent, visited, h.node, n.level FROM h JOIN nodes n ON n.node = h.node""", "readings", "nodes"))
def t21(spark: SparkSession, d: str) -> DataFrame:
    """Where each agent is, how many places they have been to, and the level they are on."""
    r = domain.readings(spark, d).select(F.col("room").alias("agent"), "ts", (F.col("event_id") % 25).alias("node"))
    own = r.groupBy("agent").agg(F.countDistinct("node").alias("visited"), F.max_by("node", "ts").alias("node"))
    return own.join(domain.nodes(spark, d).select("node", "level"), "node").select("agent", "visited", "node", "level")


@query("t05_x06_route_frames", sql(""", sc AS (SELECT CAST(n AS BIGINT) AS node, t * 1.0::DOUBLE AS t, CASE WHEN n IN (0, 4) THEN 1.0 ELSE greatest(0, least(1, 1 - 0.3 * ((n + t) % 4))) END::DOUBLE AS s FROM range(0, 5) a(n), range(0, 4) b(t)), ok AS (SELECT * FROM sc WHERE s >= 0.6),
    sy AS (SELECT t, r.u, r.v, weight * (1 + 2 * greatest(1 - a.s, 1 - b.s)) AS w FROM (SELECT u, v, weight FROM regions UNION ALL SELECT v, u, weight FROM regions) r JOIN ok a ON a.node = r.u JOIN ok b ON b.node = r.v AND b.t = a.t JOIN (SELECT DISTINCT t AS tt FROM sc) x ON x.tt = a.t),
    walk(t, start, node, path, cost) AS (SELECT DISTINCT t, u, u, [u], 0.0::DOUBLE FROM sy UNION ALL SELECT walk.t, start, v, list_append(path, v), cost + w FROM walk JOIN sy ON node = u AND sy.t = walk.t WHERE NOT list_contains(path, v)),
    best AS (SELECT t, start, arg_min(path, cost) AS path, min(cost) AS cost FROM walk WHERE node = 4 AND start <> 4 GROUP BY 1, 2)
    SELECT x.t, CAST(st AS BIGINT) AS start, round(cost, 6) AS cost, CAST(coalesce(len(path), 0) AS BIGINT) AS stops FROM (SELECT DISTINCT t FROM sc) x CROSS JOIN range(0, 4) q(st) LEFT JOIN best ON best.t = x.t AND best.start = q.st WHERE x.t IN (SELECT t FROM sy)""".replace("SELECT t, r.u", "SELECT a.t AS t, r.u"), "edges", "regions", recursive=True))  # fmt: skip
def t05(spark: SparkSession, d: str) -> DataFrame:
    """The safest cheap route of every start in every frame, under scores that a function of node and time gives."""
    times = spark.range(4).select(F.col("id").cast("double").alias("t"))
    n = spark.range(5).select(F.col("id").alias("node"))
    score = F.when(F.col("node").isin(0, 4), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 0.3 * ((F.col("node") + F.col("t")) % 4))))
    scores = n.join(times, how="cross").select("node", "t", score.alias("score"))
    made = legacy.frames(times, domain.regions(spark, d), scores, asked(spark).select("start", "goal"))
    return made.select("t", "start", F.round("cost", 6).alias("cost"), F.coalesce(F.size("path"), F.lit(0)).cast("bigint").alias("stops"))


@query("x09_subdivided_rooms", """SELECT p_partkey AS k, i AS part, CASE i WHEN 0 THEN w * (h - 1) ELSE w - a END AS area
    FROM (SELECT p_partkey, 4 + p_size % 5 AS w, 3 + p_size % 4 AS h, 1 + p_size % 2 AS a FROM part), range(0, 2) r(i)""")
def x09(spark: SparkSession, d: str) -> DataFrame:
    """An L-shaped room as rows of two boxes, by a table-valued function called sideways."""
    from ..functions.tables import register

    register(spark)
    domain.table(spark, d, "part").createOrReplaceTempView("evaquery_part")
    boxes = spark.sql("""SELECT p_partkey AS k, b.part, (b.x1 - b.x0) * (b.y1 - b.y0) AS area
    FROM evaquery_part, LATERAL subdivide_l_shape(CAST(4 + p_size % 5 AS DOUBLE), CAST(3 + p_size % 4 AS DOUBLE), CAST(1 + p_size % 2 AS DOUBLE),
    1.0D) b""")
    return boxes.select("k", "part", F.col("area").cast("bigint").alias("area"))


@query("t24_interval_and_radius_joins", sql(""", w AS (SELECT node, node * 1.0 AS start, 10.0 AS dur FROM nodes) SELECT w.node, count(*) AS n FROM w
    JOIN readings r ON r.room % 25 = w.node AND (r.event_id % 40) BETWEEN start AND start + dur GROUP BY 1""", "nodes", "readings"))
def t24(spark: SparkSession, d: str) -> DataFrame:
    spans = domain.nodes(spark, d).select("node", F.col("node").cast("double").alias("start"), F.lit(10.0).alias("dur"))
    times = domain.readings(spark, d).select((F.col("room") % 25).cast(spans.schema["node"].dataType).alias("node"), (F.col("event_id") % 40).cast("double").alias("t"))
    return joins.in_interval(times, spans, "node").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
