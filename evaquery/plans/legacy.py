"""The older map document: links inferred from rooms and doors, routes on it, walls cut by openings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import polygon as P
from ..functions.geometry import area, inflated, overlap_area, rect
from ..operators.joins import pairs_in_group
from ..sources.storage import small, stored

REACH = 0.15
DOOR_SHARE = 0.30
WALL_AREA = 0.05
LINK = "origen string, destino string, tipo string, contexto string"


def _near(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(a_*, b_*) of rectangles whose boxes, a's drawn out by REACH, share a tile; each pair once."""
    from ..operators.joins import tiles

    wide = inflated(rect(), REACH)
    left = tiles(a, size, wide).select(*[F.col(c).alias(f"a_{c}") for c in a.columns], "tx", "ty")
    right = tiles(b, size, rect()).select(*[F.col(c).alias(f"b_{c}") for c in b.columns], "tx", "ty")
    ra, rb = inflated(rect("a_"), REACH), rect("b_")
    corner = (F.floor(F.greatest(ra["x0"], rb["x0"]) / size) == F.col("tx")) & (F.floor(F.greatest(ra["y0"], rb["y0"]) / size) == F.col("ty"))
    return left.join(right, ["tx", "ty"]).where(corner & (overlap_area(ra, rb) > 0)).drop("tx", "ty")


def links(rooms: DataFrame, doors: DataFrame, size: float = 20.0) -> DataFrame:
    """Links of three kinds between rectangles (name, x0, y0, x1, y1).

    A door belongs to a room that, drawn out, covers over 30 % of it; doors of one room
    are linked through it; rooms that share a wall are linked by it.
    """
    belongs = _near(rooms, doors, size).where(overlap_area(inflated(rect("a_"), REACH), rect("b_")) > DOOR_SHARE * area(rect("b_"))).select(F.col("a_name").alias("room"), F.col("b_name").alias("door"))
    through = belongs.select(F.col("room").alias("origen"), F.col("door").alias("destino"), F.lit("navegable_puerta").alias("tipo"), F.lit(None).cast("string").alias("contexto"))
    among = pairs_in_group(belongs, "room", "door").select(F.col("a").alias("origen"), F.col("b").alias("destino"), F.lit("door_to_door").alias("tipo"), F.col("room").alias("contexto"))
    wall = _near(rooms, rooms, size).where((F.col("a_name") < F.col("b_name")) & (overlap_area(inflated(rect("a_"), REACH), rect("b_")) > WALL_AREA))
    beside = wall.select(F.col("a_name").alias("origen"), F.col("b_name").alias("destino"), F.lit("adyacencia_fisica").alias("tipo"), F.lit(None).cast("string").alias("contexto"))
    return through.unionByName(among).unionByName(beside)


def layer_links(spaces: DataFrame) -> DataFrame:
    """(nodo_id, capa_superior, capa_inferior, tipo_conexion): the two layers that show a space (name, klass)."""
    upper = F.when(F.col("klass") == "NavigableSpace", "adyacencia_fisica").when(F.col("klass").isin("TransferSpace", "AnchorSpace"), "navegable_puerta")
    lower = F.when(F.col("klass") == "NavigableSpace", "navegable_puerta").otherwise("door_to_door")
    return spaces.select(F.col("name").alias("nodo_id"), upper.alias("capa_superior"), lower.alias("capa_inferior"), F.lit("representa_el_mismo_espacio").alias("tipo_conexion")).where("capa_superior is not null")


def assigned(points: DataFrame, rooms: DataFrame, size: float = 20.0) -> DataFrame:
    """(point, room, inferred): the room a point (point, x, y) is in, the least name of several; else the first room, marked."""
    from ..operators.joins import tiles

    cut = tiles(rooms, size, rect())
    at = points.withColumn("tx", F.floor(F.col("x") / size)).withColumn("ty", F.floor(F.col("y") / size))
    inside = at.join(cut, ["tx", "ty"]).where("x >= x0 and x <= x1 and y >= y0 and y <= y1").groupBy("point").agg(F.min("name").alias("room"))
    first = rooms.agg(F.min("name").alias("first"))
    return points.join(inside, "point", "left").join(F.broadcast(first), how="cross").select("point", F.coalesce("room", "first").alias("room"), F.col("room").isNull().alias("inferred"))


def expanded(path: Column, contexts: Column) -> Column:
    """A door path with the room between each pair of doors put in; contexts[i] lies between path[i] and path[i + 1]."""
    between = lambda i: F.when(F.get(contexts, i).isNotNull() & (F.get(contexts, i) != F.get(path, i)) & (F.get(contexts, i) != F.get(path, i + 1)), F.array(F.get(contexts, i), F.get(path, i + 1))).otherwise(F.array(F.get(path, i + 1)))
    rest = F.flatten(F.transform(F.sequence(F.lit(0), F.size(path) - 2), between))
    return F.when(F.size(path) < 2, path).otherwise(F.concat(F.slice(path, F.lit(1), F.lit(1)), rest))


def congested(edges: DataFrame, crowd: DataFrame, radius: float = 3.0, each: float = 2.0) -> DataFrame:
    """Edges (u, v, weight, x, y) heavier by ``each`` for every agent (x, y) near their midpoint; nothing wears off."""
    from ..operators.joins import within

    near = within(edges.select("u", "v", "x", "y"), crowd.select("x", "y"), radius).groupBy(F.col("p_u").alias("u"), F.col("p_v").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return edges.join(near, ["u", "v"], "left").withColumn("weight", F.col("weight") + each * F.coalesce("n", F.lit(0))).drop("n")


def runtime_graph(parts: list[DataFrame], profile_ok: Column, hazard: DataFrame, policy: str = "shortest_path", k: float = 3.0) -> DataFrame:
    """Edges of several graphs as one, for a profile, under a policy: shortest_path, least_risk or dynamic_weighted.

    ``hazard`` is (node, risk); least_risk weighs risk alone (a hundredth of the length
    breaks ties), dynamic_weighted lets it lengthen the way.
    """
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    risk = lambda end: hazard.select(F.col("node").alias(end), F.col("risk").alias(f"r_{end}"))
    both = out.where(profile_ok).join(risk("u"), "u", "left").join(risk("v"), "v", "left")
    r = F.greatest(F.coalesce("r_u", F.lit(0.0)), F.coalesce("r_v", F.lit(0.0)))
    weights = {"shortest_path": F.col("weight"), "least_risk": r + F.col("weight") / 100, "dynamic_weighted": F.col("weight") * (1 + k * r)}
    if policy not in weights:
        raise ValueError(f"unknown policy {policy}")
    return both.select("u", "v", weights[policy].cast("double").alias("weight"))


def beacon_cells(beacons: DataFrame, cells: DataFrame) -> DataFrame:
    """(beacon, cell): by explicit refs where there are any, else cells (cell, x, y) within the beacon's radius.

    Radii are bounded by the greatest one, whose grid the join uses.
    """
    from ..operators.joins import within

    named = beacons.where("size(refs) > 0").select("beacon", F.explode("refs").alias("cell"))
    open_ = beacons.where("refs is null or size(refs) <= 0")
    most = open_.agg(F.max("radius")).first()[0]
    if most is None:
        return named
    near = within(open_.select("beacon", "radius", "x", "y"), cells.select("cell", "x", "y"), float(most)).where("d <= p_radius").select(F.col("p_beacon").alias("beacon"), F.col("t_cell").alias("cell"))
    return named.unionByName(near)


def cut_walls(walls: DataFrame, openings: DataFrame) -> DataFrame:
    """(wall, fragment, ring): walls (level, name, ring, and model if there are several) minus the openings of their level, fragments numbered."""

    def run(key: tuple, own: pd.DataFrame, holes: pd.DataFrame) -> pd.DataFrame:
        mass = [x for r in holes["ring"] if (c := P.cleaned([tuple(p) for p in r])) for x in P.convex_parts(c)]
        out = []
        for name, ring in sorted(zip(own["name"], own["ring"]), key=lambda r: r[0]):
            parts = P.merged(P.difference(P.convex_parts(P.cleaned([tuple(p) for p in ring])), mass))
            out += [(name, i + 1, [list(p) for p in part]) for i, part in enumerate(parts)]
        return pd.DataFrame(out, columns=["wall", "fragment", "ring"])

    by = [c for c in ("model", "level") if c in walls.columns]
    return walls.groupBy(*by).cogroup(openings.groupBy(*by)).applyInPandas(run, "wall string, fragment int, ring array<array<double>>")


def model_faults(cells: DataFrame, boundaries: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, key): references of a model's members that lead nowhere, and members without geometry."""
    from ..functions.ids import tail
    from ..operators.dq import breach, dangling, report

    by_tail = lambda df, c: df.select("id", tail(F.col(c)).alias(c))
    bounded = cells.select("id", F.explode("boundedBy").alias("r")).select("id", tail(F.col("r")).alias("boundedBy"))
    connects = edges.select("id", F.explode("connects").alias("r")).select("id", tail(F.col("r")).alias("connects"))
    return report([
        breach(cells, "cell without polygon", "id", F.coalesce(F.size("rings"), F.lit(0)) <= 0), breach(boundaries, "boundary without line", "id", F.coalesce(F.size("line"), F.lit(0)) <= 0),
        breach(nodes, "node without point", "id", F.col("x").isNull() | F.col("y").isNull()),
        dangling(by_tail(cells, "duality"), "cell duality", "duality", nodes, "id"), dangling(bounded, "cell boundedBy", "boundedBy", boundaries, "id"),
        dangling(by_tail(boundaries, "duality"), "boundary duality", "duality", edges, "id"), dangling(by_tail(nodes, "duality"), "node duality", "duality", cells, "id"),
        dangling(by_tail(edges, "duality"), "edge duality", "duality", boundaries, "id"), dangling(connects, "edge connects", "connects", nodes, "id"),
    ])


def frames(times: DataFrame, edges: DataFrame, scores: DataFrame, asked: DataFrame, threshold: float = 0.6, beta: float = 2.0) -> DataFrame:
    """(t, start, goal, cost, path, least, replan, overlap): the route of every frame, on the nodes that are safe then.

    ``scores`` is (node, t, score), ``asked`` (start, goal). A frame's masked graph is one
    task's work; what compares frames is a window over them.
    """
    from pyspark.sql import Window

    from ..functions.scalars import risk_weight
    from ..operators.windows import jaccard_with_previous
    from .kernels import routes

    ok = scores.where(F.coalesce("score", F.lit(1.0)) >= threshold)
    side = lambda end: ok.select("t", F.col("node").alias(end), F.col("score").alias(f"s_{end}"))
    masked = times.select("t").join(small(stored(edges)), how="cross").join(side("u"), ["t", "u"]).join(side("v"), ["t", "v"])
    weighed = masked.select("t", "u", "v", risk_weight(F.col("weight"), F.col("s_u"), F.col("s_v"), beta).alias("weight"))
    found = routes(weighed, asked.join(times.select("t"), how="cross"), "t")
    key = F.concat_ws("-", F.col("start").cast("string"), F.col("goal").cast("string"))
    kept = jaccard_with_previous(found.withColumn("pair", key), "pair", "t", "path")
    replan = ~F.col("path").eqNullSafe(F.lag("path").over(Window.partitionBy("pair").orderBy("t")))
    inner = kept.withColumn("replan", replan).select("*", F.explode_outer("path").alias("node")).join(scores, ["t", "node"], "left")
    return inner.groupBy("t", "start", "goal", "cost", "path", "replan", "overlap").agg(F.min(F.coalesce("score", F.lit(1.0))).alias("least"))
