"""Rectangles, points and rings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def overlap_length(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share, zero if they are apart."""
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def rect(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in ("x0", "y0", "x1", "y1")}


def boxes_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def overlap_area(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return overlap_length(a["x0"], a["x1"], b["x0"], b["x1"]) * overlap_length(a["y0"], a["y1"], b["y0"], b["y1"])


def contact_length(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Length of the border that two rectangles share without overlapping; zero otherwise."""
    side = F.when((a["x1"] == b["x0"]) | (b["x1"] == a["x0"]), overlap_length(a["y0"], a["y1"], b["y0"], b["y1"]))
    level = F.when((a["y1"] == b["y0"]) | (b["y1"] == a["y0"]), overlap_length(a["x0"], a["x1"], b["x0"], b["x1"]))
    return F.coalesce(side, level, F.lit(0))


def area(r: dict[str, Column]) -> Column:
    return (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    both = overlap_area(a, b)
    return both / (area(a) + area(b) - both)


def inflated(r: dict[str, Column], by: float) -> dict[str, Column]:
    return {"x0": r["x0"] - by, "y0": r["y0"] - by, "x1": r["x1"] + by, "y1": r["y1"] + by}


def ring(r: dict[str, Column]) -> Column:
    """Closed ring of a rectangle."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(point(r["x0"], r["y0"]), point(r["x1"], r["y0"]), point(r["x1"], r["y1"]), point(r["x0"], r["y1"]), point(r["x0"], r["y0"]))


def _sides(points: Column) -> Column:
    return F.sequence(F.lit(0), F.size(points) - 2)


def ring_area(points: Column) -> Column:
    """Signed area of a closed ring, counter-clockwise positive."""
    term = lambda i: F.get(points, i)["x"] * F.get(points, i + 1)["y"] - F.get(points, i + 1)["x"] * F.get(points, i)["y"]
    return F.aggregate(_sides(points), F.lit(0.0), lambda acc, i: acc + term(i)) / 2


def ring_length(points: Column) -> Column:
    side = lambda i: distance(F.get(points, i)["x"], F.get(points, i)["y"], F.get(points, i + 1)["x"], F.get(points, i + 1)["y"])
    return F.aggregate(_sides(points), F.lit(0.0), lambda acc, i: acc + side(i))


def ring_centroid(points: Column) -> Column:
    """struct(x, y): the centre of area; null for a ring without any."""
    cross = lambda i: F.get(points, i)["x"] * F.get(points, i + 1)["y"] - F.get(points, i + 1)["x"] * F.get(points, i)["y"]
    total = lambda axis: F.aggregate(_sides(points), F.lit(0.0), lambda acc, i: acc + (F.get(points, i)[axis] + F.get(points, i + 1)[axis]) * cross(i))
    whole = ring_area(points)
    return F.when(whole != 0, F.struct((total("x") / (6 * whole)).alias("x"), (total("y") / (6 * whole)).alias("y")))


def vertex_mean(points: Column) -> Column:
    """struct(x, y): the mean of the vertices, the closing one left out."""
    own = F.slice(points, F.lit(1), F.size(points) - 1)
    mean = lambda axis: F.aggregate(own, F.lit(0.0), lambda acc, p: acc + p[axis]) / F.size(own)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def in_ring(x: Column, y: Column, points: Column) -> Column:
    """Whether a point is inside a closed ring, by the parity of crossings to its right."""

    def crosses(i: Column) -> Column:
        a, b = F.get(points, i), F.get(points, i + 1)
        spans = (a["y"] > y) != (b["y"] > y)
        return spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return F.size(F.filter(_sides(points), crosses)) % 2 == 1


def segments_cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Whether two segments cross properly: each parts the other's ends."""
    turn = lambda px, py, qx, qy, rx, ry: F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))
    return (turn(ax, ay, bx, by, cx, cy) * turn(ax, ay, bx, by, dx, dy) < 0) & (turn(cx, cy, dx, dy, ax, ay) * turn(cx, cy, dx, dy, bx, by) < 0)


def on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """struct(t, x, y, d): projection of a point on a segment, clamped to it, and its distance."""
    vx, vy = bx - ax, by - ay
    t = F.least(F.greatest(F.coalesce(((px - ax) * vx + (py - ay) * vy) / F.nullif(vx * vx + vy * vy, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    x, y = ax + t * vx, ay + t * vy
    return F.struct(t.alias("t"), x.alias("x"), y.alias("y"), distance(px, py, x, y).alias("d"))


def wall_ring(ax: Column, ay: Column, bx: Column, by: Column, thickness: Column) -> Column:
    """Closed ring of a straight wall around its centre line; null for one without length."""
    long = distance(ax, ay, bx, by)
    nx, ny = -(by - ay) / long * thickness / 2, (bx - ax) / long * thickness / 2
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.when(long > 0, F.array(p(ax + nx, ay + ny), p(bx + nx, by + ny), p(bx - nx, by - ny), p(ax - nx, ay - ny), p(ax + nx, ay + ny)))


def resized(ax: Column, ay: Column, bx: Column, by: Column, width: Column) -> Column:
    """struct(ax, ay, bx, by): a centre line cut or drawn out to ``width`` around its midpoint."""
    half = width / 2 / F.nullif(distance(ax, ay, bx, by), F.lit(0.0))
    mx, my = (ax + bx) / 2, (ay + by) / 2
    return F.struct((mx - (bx - ax) * half).alias("ax"), (my - (by - ay) * half).alias("ay"), (mx + (bx - ax) * half).alias("bx"), (my + (by - ay) * half).alias("by"))


def junction_extension(thickness: Column, sine: Column, d: Column) -> Column:
    return F.least(thickness / (2 * sine) + d + 0.002, F.lit(0.6))


def snapped(x: Column, grid: float = 0.001) -> Column:
    return F.round(x / grid) * grid


def boundary_key(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Digest of a line that does not depend on its direction."""
    turned = (x0 > x1) | ((x0 == x1) & (y0 > y1))
    ends = [F.when(turned, x1).otherwise(x0), F.when(turned, y1).otherwise(y0), F.when(turned, x0).otherwise(x1), F.when(turned, y0).otherwise(y1)]
    return F.md5(F.concat_ws("|", *[e.cast("string") for e in ends]))


def side_of_box(mx: Column, my: Column, r: dict[str, Column]) -> Column:
    """The side of a box that a point on its border lies on."""
    return F.when(my == r["y1"], "north").when(my == r["y0"], "south").when(mx == r["x1"], "east").when(mx == r["x0"], "west")


def geojson(kind: str, points: Column) -> Column:
    """GeoJSON of a point, line or polygon, six decimals, no negative zero."""
    pair = lambda p: F.array(F.round(p["x"], 6) + F.lit(0.0), F.round(p["y"], 6) + F.lit(0.0))
    coordinates = pair(F.get(points, F.lit(0))) if kind == "Point" else F.transform(points, pair)
    if kind == "Polygon":
        coordinates = F.array(coordinates)
    return F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))
