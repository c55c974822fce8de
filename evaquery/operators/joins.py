"""Joins by place and time that have no equality of their own."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import boxes_meet, distance, rect
from ..sources.storage import stored


def tiles(df: DataFrame, size: float, r: dict[str, Column]) -> DataFrame:
    """A row for each grid tile that a row's box covers (columns tx, ty)."""
    span = lambda a, b: F.explode(F.sequence(F.floor(a / size).cast("long"), F.floor(b / size).cast("long")))
    return df.withColumn("tx", span(r["x0"], r["x1"])).withColumn("ty", span(r["y0"], r["y1"]))


def tree_tiles(df: DataFrame, same: list[str], size: float, most: int) -> DataFrame:
    """A row for each leaf that a row's box touches, of a quadtree over tiles of ``size``: columns depth, tx, ty, of the leaf's own grid.

    Rows are counted by tile; a tile with more than ``most`` goes on in its quarters, and so
    do these, until none has, but for boxes that all have a place in common: every pair of
    them meets. Leaves part the floor, so any place is in one of them.
    """
    r = rect()
    cut = tiles(df, size, r).withColumn("depth", F.lit(0))
    by, done = [*same, "tx", "ty"], None
    apart = (F.max("x0") > F.min("x1")) | (F.max("y0") > F.min("y1"))
    for depth in range(1, 40):
        counts = cut.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), apart.alias("__apart"))
        hot = stored(counts.where((F.col("__n") > most) & F.col("__apart")).select(*by))
        if hot.isEmpty():
            break
        cool = cut.join(F.broadcast(hot), by, "left_anti").select(*cut.columns)
        done = cool if done is None else done.unionByName(cool)
        half = size / 2**depth
        quarter = lambda lo, hi, t: F.explode(F.sequence(F.greatest(F.floor(lo / half).cast("long"), F.col(t) * 2), F.least(F.floor(hi / half).cast("long"), F.col(t) * 2 + 1)))  # noqa: B023,E731
        warm = cut.join(F.broadcast(hot), by, "left_semi").withColumn("qx", quarter(r["x0"], r["x1"], "tx")).withColumn("qy", quarter(r["y0"], r["y1"], "ty"))
        cut = stored(warm.drop("tx", "ty", "depth").withColumnsRenamed({"qx": "tx", "qy": "ty"}).withColumn("depth", F.lit(depth)).select(*cut.columns))
    return cut if done is None else done.unionByName(cut)


#: Boxes of one tile that meet in one task; a tile with more is cut into quarters.
TILE_ROWS = 4096


def box_pairs(df: DataFrame, key: str, same: list[str], size: float, most: int | None = None) -> DataFrame:
    """Pairs (a_*, b_*) of rows with key a < b, equal ``same`` columns and boxes that meet.

    Boxes meet within a tile of their own, so the join is on tiles, not on all pairs; a
    pair is taken in the one tile that holds the low corner of what both cover. Dense
    tiles are cut until they hold ``most`` boxes, but for boxes that lie on one another, all of whose pairs are wanted.
    The join shuffles: Spark takes what rows are cut into for no larger than the file they come from, and would broadcast it.
    """
    cut = tree_tiles(df, same, size, most or TILE_ROWS)
    a, b = (cut.select(*[F.col(c).alias(f"{p}_{c}") for c in cut.columns]) for p in "ab")
    on = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in [*same, "depth", "tx", "ty"]]
    ra, rb = rect("a_"), rect("b_")
    own = F.lit(float(size)) / F.pow(F.lit(2.0), F.col("a_depth"))
    corner = (F.floor(F.greatest(ra["x0"], rb["x0"]) / own) == F.col("a_tx")) & (F.floor(F.greatest(ra["y0"], rb["y0"]) / own) == F.col("a_ty"))
    pairs = a.join(b.hint("merge"), on).where((F.col(f"a_{key}") < F.col(f"b_{key}")) & boxes_meet(ra, rb) & corner)
    return pairs.drop("a_tx", "a_ty", "a_depth", "b_tx", "b_ty", "b_depth")


def box_join(left: DataFrame, right: DataFrame, same: list[str], size: float) -> DataFrame:
    """(l_*, r_*): rows of both, equal in ``same`` columns, whose boxes meet; each pair in one tile, as in ``box_pairs``."""
    a, b = (cut.select(*[F.col(c).alias(f"{p}_{c}") for c in cut.columns]) for p, cut in (("l", tiles(left, size, rect())), ("r", tiles(right, size, rect()))))
    on = [F.col(f"l_{c}") == F.col(f"r_{c}") for c in [*same, "tx", "ty"]]
    ra, rb = rect("l_"), rect("r_")
    corner = (F.floor(F.greatest(ra["x0"], rb["x0"]) / size) == F.col("l_tx")) & (F.floor(F.greatest(ra["y0"], rb["y0"]) / size) == F.col("l_ty"))
    return a.join(b, on).where(boxes_meet(ra, rb) & corner).drop("l_tx", "l_ty", "r_tx", "r_ty")


#: Points of one grid cell that meet its targets in one task; the points of a fuller one are dealt over several.
CELL_ROWS = 10_000


def within(points: DataFrame, targets: DataFrame, radius: float, most: int | None = None) -> DataFrame:
    """(p_*, t_*, d): points and targets (columns x, y) at most ``radius`` apart.

    Targets go to their own grid cell, points to the nine around theirs. A cell with more
    than ``most`` points is dealt over as many shares as hold that many each, and its
    targets go to every share: a pair still meets once, and no share has more points.
    The join shuffles, as in ``box_pairs``.
    """
    near = points.select(*[F.col(c).alias(f"p_{c}") for c in points.columns])
    around = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    cell = lambda c: F.floor(F.col(c) / radius)
    near = near.withColumn("dx", around).withColumn("dy", around).withColumn("gx", cell("p_x") + F.col("dx")).withColumn("gy", cell("p_y") + F.col("dy"))
    far = targets.select(*[F.col(c).alias(f"t_{c}") for c in targets.columns]).withColumn("gx", cell("t_x")).withColumn("gy", cell("t_y"))
    counts = near.groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > (most or CELL_ROWS))
    shares = stored(counts.select("gx", "gy", F.ceil(F.col("__n") / (most or CELL_ROWS)).cast("int").alias("__shares")))
    on = ["gx", "gy"]
    if not shares.isEmpty():
        known = lambda df: df.join(F.broadcast(shares), ["gx", "gy"], "left").withColumn("__shares", F.coalesce("__shares", F.lit(1)))
        near = known(near).withColumn("__share", F.pmod(F.xxhash64("p_x", "p_y", F.monotonically_increasing_id()), F.col("__shares")).cast("int")).drop("__shares")
        far = known(far).withColumn("__share", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1))).drop("__shares")
        on = ["gx", "gy", "__share"]
    joined = near.join(far.hint("merge"), on).withColumn("d", distance(F.col("p_x"), F.col("p_y"), F.col("t_x"), F.col("t_y")))
    return joined.where(F.col("d") <= radius).drop("gx", "gy", "dx", "dy", "__share")


def nearest(points: DataFrame, targets: DataFrame, key: str, target: str) -> DataFrame:
    """(key, target, d2): each point's nearest target, the least target id on ties.

    Looks within a radius, at first that of one target's share of the floor, and doubles
    it for the points that found none, so a point meets the targets around it and not
    all. Points and targets without a finite place are left out; no targets give no rows.
    """
    placed = lambda df, name: df.where(reduce(and_, [F.abs(F.col(c).cast("double")) < float("inf") for c in "xy"])).select(F.col(name), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    goals, left = stored(placed(targets, target).withColumnRenamed(target, "goal")), stored(placed(points, key))
    box = goals.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{p}{c}") for c in "xy" for p, f in (("low", F.min), ("high", F.max))]).first()
    found = left.select(F.col(key), F.lit(None).cast(goals.schema["goal"].dataType).alias(target), F.lit(None).cast("double").alias("d2")).limit(0)
    if not box["n"]:
        return found
    wide, high = box["highx"] - box["lowx"], box["highy"] - box["lowy"]
    radius = max((wide * high / box["n"]) ** 0.5, (wide + high) / box["n"], 1e-6) or 1.0
    while not left.isEmpty():
        d2 = (F.col("p_x") - F.col("t_x")) * (F.col("p_x") - F.col("t_x")) + (F.col("p_y") - F.col("t_y")) * (F.col("p_y") - F.col("t_y"))
        best = within(left, goals, radius).groupBy(F.col(f"p_{key}").alias(key)).agg(F.min(F.struct(d2.alias("d2"), F.col("t_goal").alias("goal"))).alias("b"))
        near = stored(best.select(key, F.col("b.goal").alias(target), F.col("b.d2").alias("d2")))
        found, left, radius = found.unionByName(near), stored(left.join(near.select(key), key, "left_anti")), 2 * radius
    return found


def in_interval(times: DataFrame, spans: DataFrame, key: str, bucket: float | None = None) -> DataFrame:
    """Rows of ``times`` (key, t) and of ``spans`` (key, start, dur) with start <= t <= start + dur.

    Joins on key and stretch of time, so a time meets the spans around it and not all of
    its key. A stretch is ``bucket`` long, the mean of the spans if none is given, so the
    spans lie in about two stretches each. Spans that end before they start hold no time.
    """
    if bucket is None:
        bucket = spans.where("dur >= 0").agg(F.avg(F.col("dur").cast("double"))).first()[0] or 1.0
    at = lambda t: F.floor(t.cast("double") / bucket)
    cut = spans.where("start is not null and dur >= 0").withColumn("__at", F.explode(F.sequence(at(F.col("start")), at(F.col("start") + F.col("dur")))))
    return times.withColumn("__at", at(F.col("t"))).join(cut, [key, "__at"]).where("t >= start and t <= start + dur").drop("__at")


def as_of(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """``left`` (key, ts) with the last ``value`` of ``right`` (key, ts) at or before its time.

    One pass over the union, sorted within the key; at equal times the right row comes first.
    """
    both = left.select("*", F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias(value)).unionByName(
        right.select(key, "ts", value, F.lit(0).alias("side")), allowMissingColumns=True
    )
    order = Window.partitionBy(key).orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn(value, F.last(value, ignorenulls=True).over(order))
    return filled.where("side = 1").drop("side")


def pairs_in_group(members: DataFrame, group: str, member: str) -> DataFrame:
    """(group, a, b) with a < b for members of one group; groups are rooms, so small."""
    a = members.select(F.col(group), F.col(member).alias("a")).distinct()
    b = members.select(F.col(group), F.col(member).alias("b")).distinct()
    return a.join(b, group).where("a < b")
