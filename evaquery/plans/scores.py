"""Scores over time and the scenarios that drive them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp, window_score
from ..operators.joins import in_interval, within
from ..operators.windows import smoothed

SPAN = "node, kind, start, dur, v1, v2, ordinal"


def at_times(times: DataFrame, spans: DataFrame, combine: str = "min", default: float = 1.0, alpha: float | None = None) -> DataFrame:
    """(node, t, score): the spans' values at each (node, t), combined, clamped and smoothed.

    combine is min, or last (of the greatest ordinal). Nodes without a span at a time have
    the default. With ``alpha`` a node's series is smoothed in order of time, from its
    first value on.
    """
    inside = in_interval(times, spans, "node")
    value = window_score(*[F.col(c) for c in ("kind", "t", "start", "dur", "v1", "v2")])
    valued = inside.withColumn("v", value).where("v is not null")
    one = F.min("v") if combine == "min" else F.max_by("v", "ordinal")
    found = valued.groupBy("node", "t").agg(one.alias("v"))
    out = times.join(found, ["node", "t"], "left").select("node", "t", clamp(F.coalesce("v", F.lit(default))).alias("score"))
    if alpha is None:
        return out
    return smoothed(out.select("node", F.col("t").cast("double").alias("t"), "score"), "node", "t", "score", alpha)


def _triangles(starts: DataFrame, recover: float, dip: float) -> DataFrame:
    return starts.select("node", F.lit("triangle").alias("kind"), F.col("start").cast("double").alias("start"), F.lit(recover).alias("dur"), F.lit(dip).alias("v1"), F.lit(1.0).alias("v2"), F.lit(0).alias("ordinal"))


def radial_fire(nodes: DataFrame, centre: DataFrame, t0: float = 10.0, spread: float = 0.8, dip: float = 0.5, recover: float = 30.0) -> DataFrame:
    """Spans that start as the front reaches each node (x, y) from the one row of ``centre``."""
    mid = centre.select(F.col("x").alias("cx"), F.col("y").alias("cy")).limit(1)
    far = nodes.where("x is not null and y is not null").join(F.broadcast(mid), how="cross")
    return _triangles(far.select("node", (t0 + F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) * spread).alias("start")), recover, dip)


def linear_front(nodes: DataFrame, p0: tuple[float, float], p1: tuple[float, float], t0: float = 10.0, speed: float = 0.8, dip: float = 0.5, recover: float = 25.0) -> DataFrame:
    """Spans that start as a line from ``p0`` towards ``p1`` passes each node; nodes behind start at once."""
    vx, vy = p1[0] - p0[0], p1[1] - p0[1]
    if not (size := vx * vx + vy * vy):
        raise ValueError("a front needs a direction")
    along = ((F.col("x") - p0[0]) * vx + (F.col("y") - p0[1]) * vy) / size
    return _triangles(nodes.where("x is not null and y is not null").select("node", (t0 + F.greatest(F.lit(0.0), along) * speed * size**0.5).alias("start")), recover, dip)


def phases(members: DataFrame, shape: str = "triangle", t0: float = 5.0, step: float = 6.0, dip: float = 0.5, recover: float = 25.0, ramp_down: float = 6.0, hold: float = 12.0, ramp_up: float = 8.0) -> DataFrame:
    """Spans of a sequence: ``members`` (node, phase) of phase k start at t0 + k * step."""
    own = members.select("node", (t0 + F.col("phase") * step).alias("start"))
    if shape == "triangle":
        return _triangles(own, recover, dip)
    if shape != "ramp_hold":
        raise ValueError(f"unknown shape {shape}")
    part = lambda i, kind, after, dur, v: F.struct(F.lit(kind).alias("kind"), (F.col("start") + after).cast("double").alias("start"), F.lit(dur).alias("dur"), F.lit(v).alias("v1"), F.lit(None).cast("double").alias("v2"), F.lit(i).alias("ordinal"))
    return own.select("node", F.inline(F.array(part(0, "ramp", 0.0, ramp_down, dip), part(1, "hold", ramp_down, hold, dip), part(2, "ramp", ramp_down + hold, ramp_up, 1.0))))


def growing_hazards(hazards: DataFrame, nodes: DataFrame, r0: float, growth: float, most: float, steps: int) -> DataFrame:
    """(node, t, radius, nodes_inside) of hazards whose radius grows linearly to ``most``."""
    near = within(hazards, nodes, most).groupBy(F.col("p_node").alias("node")).agg(F.collect_list("d").alias("ds"))
    radius = F.least(r0 + growth * F.col("t"), F.lit(most))
    grown = near.select("node", "ds", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))).alias("t")).withColumn("radius", radius)
    return grown.select("node", "t", "radius", F.size(F.filter("ds", lambda x: x <= F.col("radius"))).cast("long").alias("nodes_inside"))
