"""Overlays of polygons and faces of line work, as plans over edges; the SQL counts unit squares or has closed forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import halfedges, slabs
from ..registry import query
from ..sources.domain import table


def ring(*points: tuple[Column | float, Column | float]) -> Column:
    return F.array(*[F.array(*[(c if isinstance(c, Column) else F.lit(c)).cast("double") for c in p]) for p in points])


def box(x0, y0, x1, y1) -> Column:
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def shapes(spark: SparkSession, d: str) -> DataFrame:
    """A group a part: on side a a box with a hole and a U that overlaps it, on side b an L."""
    k, s = F.col("p_partkey"), F.col("p_size")
    w, h, dx, dy = 4 + s % 5, 4 + s % 4, k % 5, k % 3
    p = table(spark, d, "part").select(k.alias("grp"), w.alias("w"), h.alias("h"), dx.alias("dx"), dy.alias("dy"))
    w, h, dx, dy = (F.col(c) for c in ("w", "h", "dx", "dy"))
    a1 = F.array(box(F.lit(0), F.lit(0), w, h), box(F.lit(1), F.lit(1), F.lit(3), F.lit(3)))
    a2 = F.array(ring((w - 1, F.lit(2)), (w + 4, F.lit(2)), (w + 4, F.lit(6)), (w + 3, F.lit(6)), (w + 3, F.lit(3)), (w, F.lit(3)), (w, F.lit(6)), (w - 1, F.lit(6))))
    b = F.array(ring((dx, dy), (dx + 5, dy), (dx + 5, dy + 2), (dx + 2, dy + 2), (dx + 2, dy + 5), (dx, dy + 5)))
    each = [F.struct(F.lit(side).alias("side"), F.lit(n).alias("poly"), rings.alias("rings")) for side, n, rings in (("a", 1, a1), ("a", 2, a2), ("b", 3, b))]
    return p.select("grp", F.inline(F.array(*each)))


#: Unit squares of the shapes and which sides cover them.
SQUARES = """sq AS (SELECT p_partkey AS grp, (i < 4 + p_size % 5 AND j < 4 + p_size % 4 AND NOT (i BETWEEN 1 AND 2 AND j BETWEEN 1 AND 2))
  OR (i BETWEEN 3 + p_size % 5 AND 7 + p_size % 5 AND j BETWEEN 2 AND 5 AND (j = 2 OR i = 3 + p_size % 5 OR i = 7 + p_size % 5)) AS a,
 (i - p_partkey % 5 BETWEEN 0 AND 4 AND j - p_partkey % 3 BETWEEN 0 AND 1) OR (i - p_partkey % 5 BETWEEN 0 AND 1 AND j - p_partkey % 3 BETWEEN 0 AND 4) AS b
 FROM part, range(0, 14) x(i), range(0, 10) y(j))"""


@query("g07_g28_overlay_areas", f"""WITH {SQUARES} SELECT grp, CAST(count(*) FILTER (a) AS DOUBLE) AS area_a, CAST(count(*) FILTER (b) AS DOUBLE) AS area_b, CAST(count(*) FILTER (a AND b) AS DOUBLE) AS "both",
    CAST(count(*) FILTER (a OR b) AS DOUBLE) AS either, CAST(count(*) FILTER (a AND NOT b) AS DOUBLE) AS a_only, CAST(count(*) FILTER (b AND NOT a) AS DOUBLE) AS b_only FROM sq GROUP BY grp""")
def overlays(spark: SparkSession, d: str) -> DataFrame:
    """Areas of unions, intersections and differences of concave shapes, one with a hole; no Python in the plan."""
    return slabs.overlay_areas(shapes(spark, d), 16.0)


@query("g28_difference_parts", f"""WITH {SQUARES} SELECT grp, CAST(count(*) AS DOUBLE) AS area FROM sq WHERE a AND NOT b GROUP BY grp""")
def differences(spark: SparkSession, d: str) -> DataFrame:
    """What the L leaves of the other shapes, as parts that do not overlap, and their area."""
    parts = slabs.overlay_parts(shapes(spark, d), "a_only", 16.0)
    x, y = (lambda i: F.get(F.get("ring", i), F.lit(0))), (lambda i: F.get(F.get("ring", i), F.lit(1)))
    turn = F.aggregate(F.sequence(F.lit(0), F.size("ring") - 1), F.lit(0.0), lambda n, i: n + x(i) * y((i + 1) % F.size("ring")) - x((i + 1) % F.size("ring")) * y(i))
    return parts.groupBy("grp").agg(F.round(F.sum(turn) / 2, 6).alias("area"))


@query("g05_slanted_overlays", """WITH p AS (SELECT p_partkey AS grp, 3 + p_size % 5 + 0.0::DOUBLE AS r, 1 + p_partkey % 4 + 0.0::DOUBLE AS a, 1 + p_partkey % 5 + 0.0::DOUBLE AS b FROM part), q AS (SELECT *, least(a, r) AS m, greatest(r - b, 0.0) AS z FROM p),
    t AS (SELECT *, 4 * CASE WHEN z >= m THEN b * m ELSE b * z + r * (m - z) - (m * m - z * z) / 2 END AS o FROM q)
    SELECT grp, round(2 * r * r, 6) AS area_a, round(4 * a * b, 6) AS area_b, round(o, 6) AS "both", round(2 * r * r + 4 * a * b - o, 6) AS either, round(2 * r * r - o, 6) AS a_only, round(4 * a * b - o, 6) AS b_only FROM t""")
def slanted(spark: SparkSession, d: str) -> DataFrame:
    """A diamond and a box with one centre: their edges cross inside slabs."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("grp"), (3 + F.col("p_size") % 5).alias("r"), (1 + F.col("p_partkey") % 4).alias("a"), (1 + F.col("p_partkey") % 5).alias("b"))
    r, a, b, none = F.col("r"), F.col("a"), F.col("b"), F.lit(0)
    each = [F.struct(F.lit("a").alias("side"), F.lit(1).alias("poly"), F.array(ring((r, none), (none, r), (-r, none), (none, -r))).alias("rings")), F.struct(F.lit("b").alias("side"), F.lit(2).alias("poly"), F.array(box(-a, -b, a, b)).alias("rings"))]
    return slabs.overlay_areas(p.select("grp", F.inline(F.array(*each))), 4.0)


@query("g29_b18_faces", """WITH n AS (SELECT max(p_partkey) AS n FROM part), c AS (SELECT p_partkey AS k, p_size % 3 = 0 AS cut, (p_partkey - 1) % 50 * 10.0::DOUBLE AS x, (p_partkey - 1) // 50 * 10.0::DOUBLE AS y,
    p_partkey > 0 AND p_partkey + 50 <= n AS top, (p_partkey % 50 <> 0 OR p_partkey = 0) AND p_partkey < n AS side FROM part, n)
    SELECT x + 5 AS x, y + 5 AS y, 100.0::DOUBLE AS area FROM c WHERE NOT cut AND top AND side UNION ALL SELECT round((3 * x + 10) / 3, 6), round((3 * y + 20) / 3, 6), 50.0 FROM c WHERE cut AND top
    UNION ALL SELECT round((3 * x + 20) / 3, 6), round((3 * y + 10) / 3, 6), 50.0 FROM c WHERE cut AND side""")
def faces(spark: SparkSession, d: str) -> DataFrame:
    """Rooms between walls on a grid: a part has the wall below and the one on its left, some a slanted one, some a stub that ends in the room."""
    k, s = F.col("p_partkey"), F.col("p_size")
    p = table(spark, d, "part").select(((k - 1) % 50 * 10).cast("double").alias("x"), F.expr("cast((p_partkey - 1) div 50 * 10 as double)").alias("y"), (s % 3 == 0).alias("cut"), ((s % 7 == 0) & (s % 3 != 0)).alias("stub"))
    x, y = F.col("x"), F.col("y")
    line = lambda ax, ay, bx, by, ok: F.when(ok, F.struct(ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by")))
    lines = F.array(line(x, y, x + 10, y, F.lit(True)), line(x, y, x, y + 10, F.lit(True)), line(x, y, x + 10, y + 10, F.col("cut")), line(x + 2, y, x + 2, y + 3, F.col("stub")))
    walls = p.select(F.lit(0).alias("grp"), F.explode(F.filter(lines, lambda e: e.isNotNull())).alias("e")).select("grp", "e.*")
    return halfedges.faces(walls, 32.0)[0].select("x", "y", "area")
