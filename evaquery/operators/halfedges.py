"""Faces of line work from half-edges, as joins and windows.

Segments are cut where they meet. Each piece is two half-edges, one a direction; around a
point they are ranked by angle, and after a half-edge comes the one that is ranked before
its twin where it ends. Half-edges that follow each other go round a face; the face is
named by the least of them, which pointer doubling spreads in a number of rounds that
grows with the logarithm of its edges. No level is in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored
from .joins import box_pairs

#: Points closer than this are one.
PLACES = 6


def _xy(x: Column, y: Column) -> Column:
    return F.struct((F.round(x, PLACES) + F.lit(0.0)).alias("x"), (F.round(y, PLACES) + F.lit(0.0)).alias("y"))


def cut_lines(segments: DataFrame, size: float, most: int | None = None) -> DataFrame:
    """(grp, a, b): the pieces between neighbouring meeting points of segments (grp, ax, ay, bx, by), each once, a < b as (x, y)."""
    ends = F.array(_xy(F.col("ax").cast("double"), F.col("ay").cast("double")), _xy(F.col("bx").cast("double"), F.col("by").cast("double")))
    own = segments.select("grp", F.array_sort(ends).alias("e")).where("e[0] <> e[1]").distinct()
    own = stored(own.withColumn("sid", F.monotonically_increasing_id()).select("sid", "grp", F.col("e")[0].alias("a"), F.col("e")[1].alias("b")))
    boxes = own.select("sid", "grp", "a", "b", F.least("a.x", "b.x").alias("x0"), F.least("a.y", "b.y").alias("y0"), F.greatest("a.x", "b.x").alias("x1"), F.greatest("a.y", "b.y").alias("y1"))
    met = box_pairs(boxes, "sid", ["grp"], size, most)
    p, r = (F.col("a_a.x"), F.col("a_a.y")), (F.col("a_b.x") - F.col("a_a.x"), F.col("a_b.y") - F.col("a_a.y"))
    q, s = (F.col("b_a.x"), F.col("b_a.y")), (F.col("b_b.x") - F.col("b_a.x"), F.col("b_b.y") - F.col("b_a.y"))
    cross = lambda u, v: u[0] * v[1] - u[1] * v[0]
    gap = (q[0] - p[0], q[1] - p[1])
    turn = cross(r, s)
    t, u = cross(gap, s) / F.nullif(turn, F.lit(0.0)), cross(gap, r) / F.nullif(turn, F.lit(0.0))
    eps = 1e-9
    hit = F.when(t.between(-eps, 1 + eps) & u.between(-eps, 1 + eps), _xy(p[0] + t * r[0], p[1] + t * r[1]))
    # parallel ones may lie on each other: then the ends of each cut the other
    flat = turn.isNull() | (F.abs(turn) < eps)
    on = lambda o, d, z: (F.abs(cross((z[0] - o[0], z[1] - o[1]), d)) <= 1e-9 * F.greatest(F.lit(1.0), d[0] * d[0] + d[1] * d[1])) & ((z[0] - o[0]) * d[0] + (z[1] - o[1]) * d[1]).between(0, d[0] * d[0] + d[1] * d[1])
    ends_ = lambda side: [(F.col(f"{side}_{e}.x"), F.col(f"{side}_{e}.y")) for e in "ab"]
    cuts = lambda o, d, other: F.filter(F.array(*[F.when(flat & on(o, d, z), _xy(*z)) for z in ends_(other)], F.when(~flat, hit)), lambda x: x.isNotNull())
    found = met.select(F.col("a_sid").alias("sid"), cuts(p, r, "b").alias("at")).unionByName(met.select(F.col("b_sid").alias("sid"), cuts(q, s, "a").alias("at")))
    points = found.select("sid", F.explode("at").alias("c"))
    all_ = own.join(points.groupBy("sid").agg(F.collect_set("c").alias("c")), "sid", "left").select("grp", "a", "b", F.array_sort(F.array_distinct(F.concat(F.array("a", "b"), F.coalesce("c", F.array().cast("array<struct<x:double,y:double>>"))))).alias("c"))
    inside = F.filter("c", lambda z: (z >= F.col("a")) & (z <= F.col("b")))
    pieces = all_.select("grp", inside.alias("c")).select("grp", F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.struct(F.get("c", i).alias("a"), F.get("c", i + 1).alias("b")))).alias("s"))
    return pieces.select("grp", "s.a", "s.b").distinct()


def half_edges(pieces: DataFrame) -> DataFrame:
    """(grp, u, v, next): both directions of each piece (grp, a, b), and the end of the half-edge that goes on from v."""
    both = pieces.select("grp", F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pieces.select("grp", F.col("b").alias("u"), F.col("a").alias("v")))
    angle = F.atan2(F.col("v.y") - F.col("u.y"), F.col("v.x") - F.col("u.x"))
    round_ = Window.partitionBy("grp", "u").orderBy("angle", "v")
    whole = round_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = both.withColumn("angle", angle).withColumn("before", F.coalesce(F.lag("v").over(round_), F.last("v").over(whole)))
    # from (u, v) on: at v, what is ranked before the way back to u
    back = ranked.select("grp", F.col("u").alias("v"), F.col("v").alias("u"), F.col("before").alias("next"))
    return back.select("grp", "u", "v", "next")


def pruned(pieces: DataFrame) -> DataFrame:
    """The pieces (grp, a, b) without those that end in nothing, one after another until none does.

    A round finds the ends that one piece leads to and drops it; the chains that are left are
    shorter by a piece at each end, so rounds are as many as the longest chain has pieces.
    """
    left = stored(pieces)
    while True:
        ends = left.select("grp", F.explode(F.array("a", "b")).alias("p")).groupBy("grp", "p").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("grp", "p")
        ends = stored(ends)
        if ends.isEmpty():
            return left
        for side in "ab":
            left = left.join(ends.withColumnRenamed("p", side), ["grp", side], "left_anti").select("grp", "a", "b")
        left = stored(left)


def labelled(edges: DataFrame) -> DataFrame:
    """(grp, h, u, v, face): half-edges (grp, u, v, next) with the least half-edge of the face they go round.

    A half-edge knows the least of the 2 ** k that follow it and the one behind them; a round
    joins the two halves of twice as many. One that is the least of those that follow it has
    been gone round to, so all that name it are done and take part no more: rounds are as many
    as the longest way round takes, but only its own half-edges are in the last of them.
    """
    named = edges.select("grp", F.xxhash64("grp", "u", "v").alias("h"), F.xxhash64("grp", "v", "next").alias("to"), "u", "v")
    known = stored(named)
    open_, done = known.select("h", F.col("to").alias("face"), "to"), None  # the next one is the least of one
    while True:
        ahead = open_.select(F.col("h").alias("k"), F.col("to").alias("then"), F.col("face").alias("further"))
        step = stored(open_.join(ahead, F.col("to") == F.col("k")).select("h", F.least("face", "further").alias("face"), F.col("then").alias("to")))
        closed = step.where("h = face").select(F.col("face").alias("least"))
        step = stored(step.join(closed, F.col("face") == F.col("least"), "left").select("h", "face", "to", F.col("least").isNotNull().alias("closed")))
        over, open_ = step.where("closed").select("h", "face"), step.where("not closed").select("h", "face", "to")
        done = over if done is None else done.unionByName(over)
        if open_.isEmpty():
            return known.join(done, "h").select("grp", "h", "u", "v", "face")


def faces(segments: DataFrame, size: float, least: float = 1e-4, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((grp, face, area, x, y, edges), (grp, loose)): bounded faces of line work (grp, ax, ay, bx, by) with area, centre and
    number of edges, and how many pieces end in nothing.

    Pieces that part a face from itself count twice in its way round and not in its area.
    A face of ``least`` area or less is none. A face that lies within another one is not
    taken out of it. Groups without lines have no row in either.
    """
    pieces = stored(cut_lines(segments, size, most))
    closed = pruned(pieces)
    sides = labelled(half_edges(closed))
    turn = F.col("u.x") * F.col("v.y") - F.col("v.x") * F.col("u.y")
    sums = sides.groupBy("grp", "face").agg((F.sum(turn) / 2).alias("area"), F.sum((F.col("u.x") + F.col("v.x")) * turn).alias("sx"), F.sum((F.col("u.y") + F.col("v.y")) * turn).alias("sy"), F.count(F.lit(1)).alias("edges"))
    bounded = sums.where(F.col("area") > least).select("grp", "face", F.round("area", 6).alias("area"), F.round(F.col("sx") / (6 * F.col("area")), 6).alias("x"), F.round(F.col("sy") / (6 * F.col("area")), 6).alias("y"), "edges")
    count = lambda df, name: df.groupBy("grp").agg(F.count(F.lit(1)).alias(name))
    loose = count(pieces, "n").join(count(closed, "m"), "grp", "left").select("grp", (F.col("n") - F.coalesce("m", F.lit(0))).alias("loose"))
    return bounded, loose
