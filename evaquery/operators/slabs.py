"""Overlays of polygons by vertical slabs, in SQL functions.

The edges of all polygons are rows. Between two neighbouring abscissae, ends of edges or
places where they cross, no edges meet, so their order by height tells where each polygon
is: it begins and ends in turns. What lies between two edges of a slab is a trapezoid, and
which polygons cover it is a running sum. Any set operation is a test of these sums.

Polygons may be concave, have holes (further rings of the same polygon) and be many a
side; they are taken by the even-odd rule, so orientation is free. A group (a pair of
polygons, a level) is cut into strips of the floor, so a large one is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored

#: Abscissae and heights closer than this are one.
PLACES = 9


def ring_edges(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """(grp, side, poly, x0, y0, x1, y1), x0 < x1: the edges of polygons (grp, side, poly, rings), upright ones left out.

    A ring is an array of [x, y] points, closed or open.
    """
    ring = polygons.select("grp", "side", "poly", F.posexplode(rings).alias("ring_no", "ring")).where(F.size("ring") > 2)
    point = lambda i, k: F.round(F.get(F.get("ring", i), F.lit(k)).cast("double"), PLACES)
    size = F.size("ring")
    ends = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(point(i, 0).alias("ax"), point(i, 1).alias("ay"), point((i + 1) % size, 0).alias("bx"), point((i + 1) % size, 1).alias("by")))
    each = ring.select("grp", "side", "poly", F.inline(ends)).where("ax <> bx")
    turned = F.col("ax") > F.col("bx")
    pick = lambda a, b: F.when(turned, F.col(a)).otherwise(F.col(b))
    return each.select("grp", "side", "poly", pick("bx", "ax").alias("x0"), pick("by", "ay").alias("y0"), pick("ax", "bx").alias("x1"), pick("ay", "by").alias("y1"))


def _crossings(edges: DataFrame) -> DataFrame:
    """(grp, strip, x): abscissae inside a strip at which two of its edges cross."""
    own = edges.select("grp", "strip", "eid", "x0", "y0", "x1", "y1", ((F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))).alias("slope"))
    a, b = (own.select("grp", "strip", *[F.col(c).alias(f"{p}_{c}") for c in own.columns[2:]]) for p in "ab")
    low, high = F.greatest("a_x0", "b_x0"), F.least("a_x1", "b_x1")
    apart = (F.greatest("a_y0", "a_y1") < F.least("b_y0", "b_y1")) | (F.greatest("b_y0", "b_y1") < F.least("a_y0", "a_y1"))
    met = a.join(b, ["grp", "strip"]).where((F.col("a_eid") < F.col("b_eid")) & (low < high) & ~apart & (F.col("a_slope") != F.col("b_slope")))
    x = ((F.col("b_y0") - F.col("b_slope") * F.col("b_x0")) - (F.col("a_y0") - F.col("a_slope") * F.col("a_x0"))) / F.nullif(F.col("a_slope") - F.col("b_slope"), F.lit(0.0))
    return met.select("grp", "strip", F.round(x, PLACES).alias("x"), low.alias("low"), high.alias("high")).where("x > low and x < high").select("grp", "strip", "x")


def trapezoids(edges: DataFrame, width: float) -> DataFrame:
    """(grp, x0, x1, low0, low1, high0, high1, a, b): the parts of slabs between neighbouring edges, with the polygons of
    side a and of side b that cover them; parts that none covers, and flat ones, are left out."""
    strip = F.explode(F.sequence(F.floor(F.col("x0") / width).cast("long"), F.ceil(F.col("x1") / width).cast("long") - 1))
    cut = stored(edges.withColumn("eid", F.monotonically_increasing_id()).withColumn("strip", strip))
    left, right = F.col("strip") * F.lit(float(width)), (F.col("strip") + 1) * F.lit(float(width))
    ends = cut.select("grp", "strip", F.explode(F.array(F.greatest("x0", left), F.least("x1", right))).alias("x"))
    xs = ends.unionByName(_crossings(cut).where((F.col("x") > left) & (F.col("x") < right))).distinct()
    slabs = xs.withColumn("to", F.lead("x").over(Window.partitionBy("grp", "strip").orderBy("x"))).where("to is not null").withColumnRenamed("x", "from")
    at = lambda x: F.col("y0") + (F.col("y1") - F.col("y0")) * (x - F.col("x0")) / (F.col("x1") - F.col("x0"))
    there = cut.join(slabs, ["grp", "strip"]).where("x0 <= from and x1 >= to").select("grp", "strip", "from", "to", "side", "poly", "eid", F.round(at(F.col("from")), PLACES).alias("p"), F.round(at(F.col("to")), PLACES).alias("q"))
    there = there.withColumn("mid", F.round((F.col("p") + F.col("q")) / 2, PLACES))
    own = Window.partitionBy("grp", "strip", "from", "side", "poly").orderBy("mid", "eid")
    turn = F.when(F.row_number().over(own) % 2 == 1, 1).otherwise(-1)
    up = Window.partitionBy("grp", "strip", "from").orderBy("mid", "eid")
    sums = up.rowsBetween(Window.unboundedPreceding, 0)
    depth = lambda side: F.sum(F.when(F.col("side") == side, F.col("turn")).otherwise(0)).over(sums).alias(side)
    next_ = [F.lead(c).over(up).alias(n) for c, n in (("p", "high0"), ("q", "high1"), ("mid", "above"))]
    parts = there.withColumn("turn", turn).select("grp", F.col("from").alias("x0"), F.col("to").alias("x1"), F.col("p").alias("low0"), F.col("q").alias("low1"), "mid", *next_, depth("a"), depth("b"))
    return parts.where("above > mid and (a > 0 or b > 0)").drop("mid", "above")


def _size(test: Column | None = None) -> Column:
    """Summed area of the trapezoids for which ``test`` holds."""
    own = (F.col("x1") - F.col("x0")) * ((F.col("high0") - F.col("low0")) + (F.col("high1") - F.col("low1"))) / 2
    return F.round(F.coalesce(F.sum(own if test is None else F.when(test, own)), F.lit(0.0)), 6)


def overlay_areas(polygons: DataFrame, width: float, rings: str = "rings") -> DataFrame:
    """(grp, area_a, area_b, both, either, a_only, b_only): measures of the unions of a group's polygons of side a and side b.

    ``polygons`` has rows (grp, side, poly, rings). Nulls, rings of fewer than three points
    and flat ones have no area; a group without any area has no row.
    """
    parts = trapezoids(ring_edges(polygons, rings), width)
    a, b = F.col("a") > 0, F.col("b") > 0
    return parts.groupBy("grp").agg(_size(a).alias("area_a"), _size(b).alias("area_b"), _size(a & b).alias("both"), _size(a | b).alias("either"), _size(a & ~b).alias("a_only"), _size(b & ~a).alias("b_only"))


def overlay_parts(polygons: DataFrame, operation: str, width: float, rings: str = "rings") -> DataFrame:
    """(grp, ring): the result of ``operation`` (both, either, a_only, b_only) as trapezoids that do not overlap, a row each.

    Neighbours of one slab that differ only in what covers them are one part.
    """
    a, b = F.col("a") > 0, F.col("b") > 0
    test = {"both": a & b, "either": a | b, "a_only": a & ~b, "b_only": b & ~a}[operation]
    kept = trapezoids(ring_edges(polygons, rings), width).where(test)
    up = Window.partitionBy("grp", "x0", "x1").orderBy("low0", "low1")
    opens = F.coalesce((F.col("low0") != F.lag("high0").over(up)) | (F.col("low1") != F.lag("high1").over(up)), F.lit(True))
    run = F.sum("opens").over(up.rowsBetween(Window.unboundedPreceding, 0))
    joined = kept.withColumn("opens", opens.cast("int")).withColumn("run", run).groupBy("grp", "x0", "x1", "run").agg(F.min(F.struct("low0", "low1")).alias("l"), F.max(F.struct("high0", "high1")).alias("h"))
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    return joined.select("grp", F.array(corner("x0", "l.low0"), corner("x1", "l.low1"), corner("x1", "h.high1"), corner("x0", "h.high0")).alias("ring"))
