"""Polygon kernels over L-shaped rooms, whose measures SQL can work out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..registry import query
from ..sources.domain import table
from ..sources.storage import dealt

#: A room of w by h with a corner of a by b cut out at its upper right.
ROOM = "r AS (SELECT p_partkey AS k, 4 + p_size % 5 AS w, 3 + p_size % 4 AS h, 1 + p_size % 2 AS a, 1 + p_size % 3 * 0.5::DOUBLE AS b FROM part)"


def _ring(*points: tuple[Column | float, Column | float]) -> Column:
    at = lambda v: v.cast("double") if isinstance(v, Column) else F.lit(float(v))
    return F.array(*[F.array(at(x), at(y)) for x, y in points])


def rooms(spark: SparkSession, d: str) -> DataFrame:
    """L-shaped rooms, dealt over tasks before any Python. What is made of them is taken apart by outer generators, as Spark
    would put the filter of a plain one, and with it the Python, before the dealing."""
    s = F.col("p_size")
    part = dealt(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    r = part.select(F.col("p_partkey").alias("k"), (4 + s % 5).alias("w"), (3 + s % 4).alias("h"), (1 + s % 2).alias("a"), (1 + s % 3 * 0.5).alias("b"))
    w, h, a, b = (F.col(c) for c in "whab")
    ell = _ring((0, 0), (w / 2, 0), (w, 0), (w, h - b), (w, h - b), (w - a, h - b), (w - a, h), (0, h), (0, 0))  # with a straight and a repeated point
    return r.withColumn("ell", ell).withColumn("box", _ring((0, 0), (w, 0), (w, h), (0, h)))


@query("g04_g11_g31_g45_cleaned_rings", f"""WITH {ROOM}, s AS (SELECT *, w * h - a * b AS area FROM r)
    SELECT k, CAST(6 AS INTEGER) AS points, round(area, 6)::DOUBLE AS area, false AS ell_convex, true AS box_convex, round((w * h * w / 2.0 - a * b *
    (w - a / 2.0)) / area, 6) AS x, round((w * h * h / 2.0 - a * b * (h - b / 2.0)) / area, 6) AS y FROM s""")
def g04(spark: SparkSession, d: str) -> DataFrame:
    point = S.node_point(F.col("ell"))
    made = rooms(spark, d).select("k", S.clean(F.col("ell")).alias("ring"), S.convex(F.col("ell")).alias("ell_convex"), S.convex(F.col("box")).alias("box_convex"), point.alias("p"))
    return made.select("k", F.size("ring").alias("points"), F.round(S.area(F.col("ring")), 6).alias("area"), "ell_convex", "box_convex", F.round(F.get("p", F.lit(0)), 6).alias("x"), F.round(F.get("p", F.lit(1)), 6).alias("y"))


@query("g05_g06_g07_g28_set_operations", f"""WITH {ROOM} SELECT k, round(w * h + w * h - 2.0 * (h - 1), 6) AS together, round(w * h - a * b,
    6)::DOUBLE AS both, round(a * b, 6)::DOUBLE AS either, round(w * h - a * b - 1.5 * 1.0, 6)::DOUBLE AS rest FROM r""")
def g07(spark: SparkSession, d: str) -> DataFrame:
    """Two boxes as one, a box and its L, and what a column leaves of an L."""
    w, h = F.col("w"), F.col("h")
    moved = _ring((w - 2, 1), (2 * w - 2, 1), (2 * w - 2, h + 1), (w - 2, h + 1))
    column = _ring((0.5, 0.5), (2, 0.5), (2, 1.5), (0.5, 1.5))
    r = rooms(spark, d)
    made = r.select("k", S.union_area(F.array(F.col("box"), moved)).alias("together"), S.intersection_area(F.col("box"), F.col("ell")).alias("both"), S.symmetric_difference_area(F.col("box"), F.col("ell")).alias("either"), S.difference(F.col("ell"), F.array(column)).alias("parts"))
    left = made.select("k", "together", "both", "either", F.explode_outer("parts").alias("part")).where("part is not null").withColumn("size", S.area(F.col("part")))
    return left.groupBy("k", "together", "both", "either").agg(F.sum("size").alias("rest")).select("k", *[F.round(c, 6).alias(c) for c in ("together", "both", "either", "rest")])


@query("g30_g32_g33_b19_q15_decompositions", f"""WITH {ROOM} SELECT k, CAST(4 AS INTEGER) AS triangles, true AS joined, round(w * h - a * b,
    6)::DOUBLE AS area, true AS all_convex FROM r""")
def g30(spark: SparkSession, d: str) -> DataFrame:
    """An L falls into convex parts that hang together by their borders, cover it and do not overlap."""
    made = rooms(spark, d).select("k", F.size(S.triangulated(F.col("ell"))).alias("triangles"), S.decomposed(F.col("ell")).alias("ps"), F.size(S.inner_borders(F.col("ell"))).alias("borders"))
    each = made.select("k", "triangles", (F.size("ps") <= F.col("borders") + 1).alias("joined"), F.explode_outer("ps").alias("p")).where("p is not null").select("*", S.area(F.col("p")).alias("size"), S.convex(F.col("p")).alias("fine"))
    return each.groupBy("k", "triangles", "joined").agg(F.round(F.sum("size"), 6).alias("area"), F.bool_and("fine").alias("all_convex"))


@query("g09_g10_contact_lines", f"WITH {ROOM} SELECT k, w::DOUBLE AS x, round(h - b, 6)::DOUBLE AS length FROM r")
def g10(spark: SparkSession, d: str) -> DataFrame:
    """The border an L shares with the box on its right."""
    w, h = F.col("w"), F.col("h")
    line = rooms(spark, d).select("k", S.contact(F.col("ell"), _ring((w, 0), (w + 3, 0), (w + 3, h), (w, h))).alias("l"))
    return line.select("k", F.get("l", F.lit(0)).alias("x"), F.round(F.hypot(F.get("l", F.lit(2)) - F.get("l", F.lit(0)), F.get("l", F.lit(3)) - F.get("l", F.lit(1))), 6).alias("length"))


@query("g40_ways_inside", f"WITH {ROOM} SELECT k, round(a / 2.0 + b / 2.0, 6) AS bent, round(sqrt((w - a - 0.5) ** 2 + (h - 1.0) ** 2), 6) AS straight FROM r")
def g40(spark: SparkSession, d: str) -> DataFrame:
    """Around the cut corner of an L, and straight across it."""
    w, h, a, b = (F.col(c) for c in "whab")
    p = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    bent = S.way_inside(F.col("ell"), p(w - a / 2, h - b), p(w - a, h - b / 2))
    straight = S.way_inside(F.col("ell"), p(F.lit(0.25), F.lit(0.5)), p(w - a - 0.25, h - 0.5))
    return rooms(spark, d).select("k", F.round(bent, 6).alias("bent"), F.round(straight, 6).alias("straight"))


@query("g29_faces", f"""WITH {ROOM} SELECT k, CAST(2 AS INTEGER) AS faces, round(greatest(2 * h, (w - 2) * h), 6)::DOUBLE AS largest, round(w * h,
    6)::DOUBLE AS area FROM r""")
def g29(spark: SparkSession, d: str) -> DataFrame:
    """Rooms that four walls, one inside and one that ends in nothing enclose."""
    w, h = (F.col(c).cast("double") for c in "wh")
    zero = F.lit(0.0)
    lines = F.array(F.array(zero, zero, w, zero), F.array(w, zero, w, h), F.array(w, h, zero, h), F.array(zero, h, zero, zero), F.array(F.lit(2.0), zero, F.lit(2.0), h), F.array(w, zero, w + 1, zero - 1))
    made = rooms(spark, d).select("k", S.faces(lines).alias("fs")).select("k", F.size("fs").alias("faces"), F.posexplode_outer("fs").alias("i", "f")).where("f is not null").select("*", S.area(F.col("f")).alias("size"))
    return made.groupBy("k", "faces").agg(F.round(F.max("size"), 6).alias("largest"), F.round(F.sum("size"), 6).alias("area"))


@query("g34_g36_junctions", f"WITH {ROOM} SELECT k, list_sort([(w::DOUBLE) || ' 0.0 L', '2.0 0.0 T']) AS met, [2, 1] AS clusters FROM r")
def g34(spark: SparkSession, d: str) -> DataFrame:
    """Where three walls meet, and points close by taken as one."""
    w, h = (F.col(c).cast("double") for c in "wh")
    zero, two = F.lit(0.0), F.lit(2.0)
    lines = F.array(F.array(zero, zero, w, zero), F.array(w, zero, w, h), F.array(two, zero, two, h - 1))
    return rooms(spark, d).select("k", S.junctions(lines).alias("met"), S.cluster_sizes(_ring((0, 0), (F.col("w"), 0), (0.01, 0.01))).alias("clusters"))


@query("g39_b24_tile_chains", f"WITH {ROOM} SELECT k, CASE WHEN k % 4 <> 0 THEN round(w * 0.25, 6)::DOUBLE END AS area FROM r")
def g39(spark: SparkSession, d: str) -> DataFrame:
    """Chains of half-metre tiles, a fourth of them with a gap."""
    tile = lambda i: F.array(F.when((F.col("k") % 4 == 0) & (i == 2), i + 5).otherwise(i).cast("double"), F.lit(0.0))
    chain = F.transform(F.sequence(F.lit(0), F.col("w").cast("int") - 1), tile)
    return rooms(spark, d).select("k", F.round(S.tile_area(chain, 0.5), 6).alias("area"))


@query("g38_b06_side_coverage", f"""WITH {ROOM} SELECT k, round(0.12 * (2 * w + 2 * (h + 0.24) -
    CASE WHEN k % 3 = 0 THEN w WHEN k % 3 = 1 THEN w + h + 0.24 ELSE 0 END), 6)::DOUBLE AS area FROM r""")
def g38(spark: SparkSession, d: str) -> DataFrame:
    sides = F.when(F.col("k") % 3 == 0, F.array(F.lit("north"))).when(F.col("k") % 3 == 1, F.array(F.lit("south"), F.lit("east"))).otherwise(F.array().cast("array<string>"))
    box = F.array(F.lit(0.0), F.lit(0.0), F.col("w").cast("double"), F.col("h").cast("double"))
    return rooms(spark, d).select("k", F.round(S.coverage_area(box, sides), 6).alias("area"))


@query("g03_mitred_walls", f"WITH {ROOM} SELECT k, round(0.4 * (w + h), 6)::DOUBLE AS area FROM r")
def g03(spark: SparkSession, d: str) -> DataFrame:
    """Walls around a corner: what the mitre adds outside it takes away inside."""
    line = _ring((0, 0), (F.col("w") / 2, 0), (F.col("w"), 0), (F.col("w"), F.col("h")))
    return rooms(spark, d).select("k", F.round(S.ribbon_area(line, F.lit(0.4)), 6).alias("area"))


@query("g21_merged_lines", f"WITH {ROOM} SELECT k, CAST(3 AS INTEGER) AS lines, CAST(3 AS INTEGER) AS longest FROM r")
def g21(spark: SparkSession, d: str) -> DataFrame:
    """Five lines, one of them twice, three of which meet in a point: three lines come of them."""
    w, h = (F.col(c).cast("double") for c in "wh")
    zero = F.lit(0.0)
    lines = F.array(F.array(zero, zero, w, zero), F.array(w, zero, zero, zero), F.array(w, h, w, zero), F.array(w, h, 2 * w, h), F.array(3 * w, h, 2 * w, h), F.array(w, h, w, 2 * h))
    made = rooms(spark, d).select("k", S.chained(lines).alias("ls"))
    return made.select("k", F.size("ls").alias("lines"), F.array_max(F.transform("ls", F.size)).alias("longest"))


@query("g37_junction_masses", f"WITH {ROOM} SELECT k, round(0.3 * 0.3, 6)::DOUBLE AS area FROM r")
def g37(spark: SparkSession, d: str) -> DataFrame:
    """Where two walls of 0.3 meet at a right angle they share a square."""
    w, h = (F.col(c).cast("double") for c in "wh")
    zero = F.lit(0.0)
    return rooms(spark, d).select("k", F.round(S.junction_area(F.array(F.array(zero, zero, w, zero), F.array(w, zero, w, h)), F.lit(0.3)), 6).alias("area"))
