"""From authored features to cells, boundaries and the dual graph.

Features are rows (level, kind, name, ring, thickness, width, host): walls, doors, exits
and windows are centre lines of two points; spaces, objects and connector endpoints are
rings; virtual boundaries are lines. Features of many models carry a column model too.
Inside a level order matters, and follows the feature's name; a feature meets only those
near it, so a level of any size is built by many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import polygon as P
from ..functions.geometry import on_segment
from ..functions.ids import compact_cell, edge_of_boundary, node_of_cell, numbered
from ..functions.scalars import boundary_role, edge_weight, exterior_role
from ..operators.joins import box_join, box_pairs
from ..sources.storage import stored, tasks

FEATURE = "level string, kind string, name string, ring array<array<double>>, thickness double, width double, host string"
CELL = "level string, cell string, source string, navigation_type string, category string, traversable boolean, ring array<array<double>>, x double, y double, area double"
CONTACT = "level string, a string, b string, is_virtual boolean, ax double, ay double, bx double, by double, length double"

#: Authored line types and what they become.
WALLS = ("muro_exterior", "muro_interior")
OPENINGS = {"puerta_simple": "Door", "puerta_doble": "Door", "salida": "Exit", "ventana": "Window", "ventana_practicable": "Window"}
CONNECTORS = {"stair": "Stair", "ramp": "Ramp", "elevator": "Elevator"}
#: Attributes that a category has unless it is given others.
DEFAULTS = {
    "Window": {"windowType": "fixed", "defaultTraversable": "false", "scenarioControllable": "true", "sillHeightM": "0.9"},
    "Door": {"defaultTraversable": "true"},
    "Stair": {"requiresSteps": "true", "wheelchairAccessible": "false"},
    "Ramp": {"requiresSteps": "false", "wheelchairAccessible": "true", "slope": "0.08"},
    "Elevator": {"requiresSteps": "false", "wheelchairAccessible": "true"},
}
#: What one can use each connector with.
CONNECTOR_LOCOMOTION = {"Elevator": ("Walking", "Rolling"), "Ramp": ("Walking", "Rolling"), "Stair": ("Walking",)}


def is_opening(kind: Column) -> Column:
    return kind.isin(*OPENINGS)


def is_transfer(kind: Column, name: Column, klass: Column) -> Column:
    """A space that only leads on: by type, by what its name holds, or by class."""
    low = F.lower(F.coalesce(name, F.lit("")))
    named = low.contains("puerta") | low.contains("salida") | low.contains("ventana") | low.contains("window") | low.contains("frontera")
    return F.coalesce(kind.isin(*OPENINGS, *CONNECTORS, "frontera_virtual"), F.lit(False)) | named | F.coalesce(klass.isin("TransferSpace", "AnchorSpace"), F.lit(False))


def connector_locomotion(kind: Column) -> Column:
    out = F.array(F.lit("Walking"))
    for name, allowed in CONNECTOR_LOCOMOTION.items():
        out = F.when(kind == name, F.array(*map(F.lit, allowed))).otherwise(out)
    return out


def next_level(levels: DataFrame) -> DataFrame:
    """(id, target): the level above in order, a top level itself; of levels that name their model, (model, id, target) within it."""
    model = [c for c in ("model",) if c in levels.columns]
    by = (Window.partitionBy(*model) if model else Window).orderBy("order", "id")
    return levels.select(*model, "id", F.coalesce(F.lead("id").over(by), F.col("id")).alias("target"))


def is_object(markers: Column) -> Column:
    return F.arrays_overlap(F.transform(markers, F.lower), F.array(*map(F.lit, ("objectspace", "object", "column", "obstacle"))))


def with_defaults(category: Column, attributes: Column) -> Column:
    """Attributes over the defaults of a category."""
    empty = F.create_map().cast("map<string,string>")
    base = empty
    for name, values in DEFAULTS.items():
        base = F.when(category == name, F.create_map(*[F.lit(x) for kv in values.items() for x in kv])).otherwise(base)
    own = F.coalesce(attributes, empty)
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)


def source_features(features: DataFrame) -> DataFrame:
    """Features with ids SF_<level>_<kind>_<n>, counted by type in order of name."""
    n = F.row_number().over(Window.partitionBy(*_by(features), "kind").orderBy("name"))
    return features.withColumn("feature", F.concat_ws("_", F.lit("SF"), F.upper("level"), F.upper("kind"), numbered("", n, 3)))


def _points(ring: object) -> list[P.Point]:
    return [(float(p[0]), float(p[1])) for p in ring]


def _by(df: DataFrame) -> list[str]:
    """What tells levels apart: the level, and the model where there are several."""
    return [c for c in ("model", "level") if c in df.columns]


def _schema(df: DataFrame, ddl: str) -> str:
    return ("model string, " if "model" in df.columns else "") + ddl


def _named(rows: pd.DataFrame, key: tuple, ddl: str, out: list[tuple]) -> pd.DataFrame:
    """Rows of ``ddl``, the model of ``key`` before them where it has one."""
    names = [c.split(" ")[0] for c in ddl.split(", ")]
    made = pd.DataFrame(out, columns=names)
    if len(key) > 1:
        made.insert(0, "model", key[0])
    return made


#: Size of the tiles in which the features of a level look for those they meet.
TILE = 16.0
RINGS = "array<array<array<double>>>"
BOX = "x0 double, y0 double, x1 double, y1 double"
PART = f"rank int, turn string, label string, source string, navigation_type string, category string, traversable boolean, parts {RINGS}, {BOX}"


def _box(parts: list[P.Ring]) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for r in parts for p in r], [p[1] for r in parts for p in r]
    return min(xs), min(ys), max(xs), max(ys)


def _rings(parts: list[P.Ring]) -> list:
    return [[list(p) for p in r] for r in parts]


def _opening(r) -> P.Ring | None:
    """The footprint of an opening: as wide as it is given, as thick as its host."""
    a, b = _points(r.ring)[:2]
    thick = r.host_thickness if r.hosted else r.thickness if r.thickness == r.thickness and r.thickness else 0.1
    size = math.dist(a, b)
    if r.width == r.width and r.width and size:
        mid, half = ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2), r.width / 2 / size
        a, b = (mid[0] - (b[0] - a[0]) * half, mid[1] - (b[1] - a[1]) * half), (mid[0] + (b[0] - a[0]) * half, mid[1] + (b[1] - a[1]) * half)
    return P.band(a, b, thick)


def _footprint(r) -> tuple | None:
    """(rank, label, navigation type, category, traversable, convex parts) of one feature."""
    if r.kind == "object":
        ring, own = P.cleaned(_points(r.ring)), (0, "OBJECT", "ObjectSpace", "Column", False)
    elif r.kind in OPENINGS or r.kind in CONNECTORS:
        category = OPENINGS.get(r.kind) or CONNECTORS[r.kind]
        ring, own = _opening(r) if r.kind in OPENINGS else P.cleaned(_points(r.ring)), (1, category.upper(), "TransferSpace", category, category != "Window")
    elif r.kind in WALLS:
        ring, own = P.band(*_points(r.ring)[:2], r.thickness), (3, "WALL", "NonNavigableSpace", "WallSegment", False)
    else:
        ring, own = P.cleaned(_points(r.ring)), (4, "ROOM", "GeneralSpace", "Room", None)
    return (*own, P.convex_parts(ring)) if ring else None


def footprints(features: DataFrame) -> DataFrame:
    """(level, rank, turn, label, source, ..., parts, x0, y0, x1, y1): what each feature would cover alone, in convex parts.

    A feature yields to those of lesser (rank, turn): objects, openings and connectors,
    junctions of walls, walls, spaces, and among these by kind and name.
    """
    by = _by(features)
    hosts = features.groupBy(*by, F.col("name").alias("host")).agg(F.max_by("thickness", "kind").alias("host_thickness")).withColumn("hosted", F.lit(True))
    known = features.where(F.col("kind").isin("object", "space", *OPENINGS, *CONNECTORS, *WALLS))
    own = known.join(hosts, [*by, "host"], "left").withColumn("hosted", F.coalesce("hosted", F.lit(False)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                if made := _footprint(r):
                    rank, label, nav, category, passes, parts = made
                    out.append((*(getattr(r, c) for c in by), rank, f"{r.kind}\x01{r.name}", label, r.name, nav, category, passes, _rings(parts), *_box(parts)))
            yield pd.DataFrame(out, columns=[*by, *(c.split(" ")[0] for c in PART.split(", "))]).astype({"traversable": object})

    made = own.select(*by, "kind", "name", "ring", "thickness", "width", "hosted", "host_thickness").mapInPandas(run, _schema(features, f"level string, {PART}"))
    return made.unionByName(junctions(features))


def junctions(features: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """The masses where two walls of a level meet, as ``footprints`` has them; only walls whose boxes come near are compared."""
    by = _by(features)
    end = lambda i, k: F.get(F.get("ring", F.lit(i)), F.lit(k))
    wall = features.where(F.col("kind").isin(*WALLS)).select(*by, F.concat_ws("\x01", "kind", "name").alias("wall"), F.col("name").alias("wall_name"), "ring", "thickness", *[(f(end(0, k), end(1, k)) + F.lit(d)).alias(n) for n, f, k, d in (("x0", F.least, 0, -tolerance), ("y0", F.least, 1, -tolerance), ("x1", F.greatest, 0, tolerance), ("y1", F.greatest, 1, tolerance))])
    near = box_pairs(wall, "wall", by, TILE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                both = [(*_points(ring)[:2], thick) for ring, thick in ((r.a_ring, r.a_thickness), (r.b_ring, r.b_thickness))]
                for n, (point, i, j, _, sine) in enumerate(P.junctions([w[:2] for w in both], tolerance)):
                    if mass := P.junction_mass(both, point, [i, j], sine):
                        out.append((*(getattr(r, f"a_{c}") for c in by), 2, f"{r.a_wall}\x01{r.b_wall}\x01{n}", "WALLJUNCTION", f"{r.a_wall_name}+{r.b_wall_name}", "NonNavigableSpace", "WallJunction", False, _rings(mass), *_box(mass)))
            yield pd.DataFrame(out, columns=[*by, *(c.split(" ")[0] for c in PART.split(", "))]).astype({"traversable": object})

    return near.mapInPandas(run, _schema(features, f"level string, {PART}"))


def cells(features: DataFrame) -> DataFrame:
    """Non-overlapping cells of every level: objects, transfers, walls, then rooms, each clipped by those before.

    What those before leave is what no footprint of theirs covers, so a feature is clipped by
    the footprints of greater priority that its box meets, and by itself: features, not
    levels, are dealt over the tasks. Only the numbers of cells are given in order of a level's kind.
    """
    by = _by(features)
    all_ = stored(footprints(features).withColumn("key", F.struct("rank", "turn")))
    met = box_pairs(all_.select(*by, "key", "parts", "x0", "y0", "x1", "y1"), "key", by, TILE)
    over = met.groupBy(*[F.col(f"b_{c}").alias(c) for c in by], F.col("b_key").alias("key")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("a_key", "a_parts"))), lambda x: x["a_parts"])).alias("over"))
    names = [*by, "rank", "turn", "label", "source", "navigation_type", "category", "traversable"]
    own = all_.join(over, [*by, "key"], "left").select(*names, "parts", "over")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                left = P.difference([_points(x) for x in r.parts], [] if r.over is None else [_points(x) for x in r.over])
                for n, ring in enumerate(P.merged(left)):
                    out.append((*(getattr(r, c) for c in names), n, [list(p) for p in ring], *P.inner_point(ring), abs(P.area(ring))))
            yield pd.DataFrame(out, columns=[*names, "part", "ring", "x", "y", "area"]).astype({"traversable": object})

    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    made = own.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", part int, ring array<array<double>>, x double, y double, area double")
    no = F.row_number().over(Window.partitionBy(*by, "label").orderBy("rank", "turn", "part"))
    cell = numbered(F.concat(F.concat_ws("_", F.lit("CS"), *by, "label"), F.lit("_")), no, 3)
    return made.select(*by, cell.alias("cell"), "source", "navigation_type", "category", "traversable", "ring", "x", "y", "area")


def contacts(cells_: DataFrame, features: DataFrame) -> DataFrame:
    """Straight borders of two cells of a level; those along a virtual line are virtual.

    Only cells whose boxes meet are compared, a pair a row, and only lines whose boxes meet a border's.
    """
    by, near = _by(cells_), 1e-6
    xs = lambda k: F.transform("ring", lambda p: F.get(p, F.lit(k)))
    boxes = [(f(xs(k)) + F.lit(d)).alias(n) for n, f, k, d in (("x0", F.array_min, 0, -near), ("y0", F.array_min, 1, -near), ("x1", F.array_max, 0, near), ("y1", F.array_max, 1, near))]
    pairs = box_pairs(cells_.select(*by, "cell", "ring", *boxes), "cell", by, TILE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                if line := P.contact(_points(r.a_ring), _points(r.b_ring)):
                    out.append((*(getattr(r, f"a_{c}") for c in by), r.a_cell, r.b_cell, *line[0], *line[1], math.dist(*line)))
            yield pd.DataFrame(out, columns=[*by, "a", "b", "ax", "ay", "bx", "by", "length"])

    found = stored(pairs.mapInPandas(run, _schema(cells_, "level string, a string, b string, ax double, ay double, bx double, by double, length double")))
    sides = [(f(F.col(f"a{k}"), F.col(f"b{k}")) + F.lit(d)).alias(f"{k}{n}") for f, n, d in ((F.least, 0, -near), (F.greatest, 1, near)) for k in "xy"]
    end = lambda i, k: F.get(F.get("ring", F.lit(i)), F.lit(k))
    virtual = features.where("kind = 'frontera_virtual'").select(*by, *[end(i, k).alias(n) for n, i, k in (("ax", 0, 0), ("ay", 0, 1), ("bx", 1, 0), ("by", 1, 1))]).select("*", *sides)
    met = box_join(found.select(*by, "a", "b", "ax", "ay", "bx", "by", *sides), virtual, by, TILE)
    line = [F.col(f"r_{c}") for c in ("ax", "ay", "bx", "by")]
    on = lambda e: on_segment(F.col(f"l_{e}x"), F.col(f"l_{e}y"), *line)["d"] <= near
    soft = met.where(on("a") & on("b")).select(*[F.col(f"l_{c}").alias(c) for c in (*by, "a", "b")]).distinct().withColumn("is_virtual", F.lit(True))
    both = found.join(soft, [*by, "a", "b"], "left").withColumn("is_virtual", F.coalesce("is_virtual", F.lit(False)))
    return both.select(*by, "a", "b", "is_virtual", "ax", "ay", "bx", "by", "length")


def boundaries(cells_: DataFrame, contacts_: DataFrame) -> DataFrame:
    """Contacts with id, role and whether they let pass; contacts without a role (and not virtual) are left out."""
    side = lambda p: cells_.select(F.col("cell").alias(p), F.col("navigation_type").alias(f"t{p}"), F.col("category").alias(f"c{p}"), F.col("traversable").alias(f"p{p}"))
    both = contacts_.join(side("a"), "a").join(side("b"), "b")
    blocked = F.coalesce(F.when(F.col("ta") == "TransferSpace", ~F.col("pa")).when(F.col("tb") == "TransferSpace", ~F.col("pb")), F.lit(False))
    wall = lambda p: F.col(f"c{p}").isin("WallSegment", "WallJunction")
    role = F.when(F.col("is_virtual"), "virtual").otherwise(boundary_role(F.col("ta"), F.col("tb"), blocked, wall("a"), wall("b")))
    role = F.coalesce(role, F.when((F.col("ta") == "GeneralSpace") & (F.col("tb") == "GeneralSpace"), "general_general_contact"))
    short = lambda c: F.regexp_replace(c, "^CS_", "")
    named = both.withColumn("role", role).where("role is not null").withColumn("base", F.concat_ws("_", F.lit("CB"), short("a"), short("b")))
    n = F.row_number().over(Window.partitionBy("base").orderBy(F.desc("length"), "ax", "ay"))
    named = named.withColumn("boundary", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.lpad(n.cast("string"), 2, "0"))))
    passes = F.col("role").isin("virtual", "general_transfer_contact", "general_general_contact")
    return named.select("level", "boundary", "a", "b", "is_virtual", "role", passes.alias("traversable"), "ax", "ay", "bx", "by", "length")


def dual(cells_: DataFrame, bounds: DataFrame, mode: str = "navigation") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a node a cell, an edge a boundary. navigation leaves out what cannot be passed, all_adjacency keeps it."""
    if mode not in ("navigation", "all_adjacency"):
        raise ValueError(f"unknown edge mode {mode}")
    nodes = cells_.select(node_of_cell(F.col("cell")).alias("node"), "cell", "level", "navigation_type", "category", "x", "y")
    kept = bounds if mode == "all_adjacency" else bounds.where("traversable")
    at = lambda p: cells_.select(F.col("cell").alias(p), F.col("x").alias(f"x{p}"), F.col("y").alias(f"y{p}"))
    both = kept.join(at("a"), "a").join(at("b"), "b")
    weight = edge_weight(F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")))
    return nodes, both.select(edge_of_boundary(F.col("boundary")).alias("edge"), "boundary", "a", "b", "role", "traversable", weight.alias("weight"))


def exposed_length(cells_: DataFrame, contacts_: DataFrame) -> DataFrame:
    """(cell, exposed): border length that no contact covers."""
    around = F.aggregate(F.sequence(F.lit(0), F.size("ring") - 1), F.lit(0.0), lambda acc, i: acc + F.hypot(F.get(F.get("ring", i), F.lit(0)) - F.get(F.get("ring", (i + 1) % F.size("ring")), F.lit(0)), F.get(F.get("ring", i), F.lit(1)) - F.get(F.get("ring", (i + 1) % F.size("ring")), F.lit(1))))
    shared = contacts_.select(F.explode(F.array("a", "b")).alias("cell"), "length").groupBy("cell").agg(F.sum("length").alias("shared"))
    return cells_.select("cell", around.alias("around")).join(shared, "cell", "left").select("cell", F.round(F.greatest(F.col("around") - F.coalesce("shared", F.lit(0.0)), F.lit(0.0)), 6).alias("exposed"))


def exterior_boundaries(cells_: DataFrame, contacts_: DataFrame, least: float = 0.1) -> DataFrame:
    """(boundary, cell, role, ax, ay, bx, by): the stretches of a cell's border that face outside.

    Of cells that anchor the outside or are outer wall (columns function and
    source_wall_types); a stretch is what the contacts leave of a side, ``least`` long at
    least. Ids are told apart by a number from the second stretch of a cell on.
    """
    role = exterior_role(F.col("navigation_type"), F.col("function"), F.col("source_wall_types"))
    outer = cells_.withColumn("role", role).where("role is not null")
    corner = lambda i, k: F.get(F.get("ring", i % F.size("ring")), F.lit(k))
    ends = lambda i: F.struct(*[corner(j, k).alias(n) for n, j, k in (("ax", i, 0), ("ay", i, 1), ("bx", i + 1, 0), ("by", i + 1, 1))])
    sides = outer.select("cell", "level", "role", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("ring") - 1), ends)).alias("side", "s")).select("cell", "level", "role", "side", "s.*")
    own = contacts_.select(F.explode(F.array("a", "b")).alias("cell"), *[F.col(c).alias(f"c{c}") for c in ("ax", "ay", "bx", "by")])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    along = lambda x, y: ((F.col(x) - F.col("ax")) * dx + (F.col(y) - F.col("ay")) * dy) / (dx * dx + dy * dy)
    off = lambda x, y: F.abs((F.col(x) - F.col("ax")) * dy - (F.col(y) - F.col("ay")) * dx) / F.hypot(dx, dy)
    on = (off("cax", "cay") <= 1e-6) & (off("cbx", "cby") <= 1e-6)
    clip = lambda t: F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    taken = F.when(on, F.struct(clip(F.least(along("cax", "cay"), along("cbx", "cby"))).alias("a"), clip(F.greatest(along("cax", "cay"), along("cbx", "cby"))).alias("b")))
    keys = ["cell", "level", "role", "side", "ax", "ay", "bx", "by"]
    met = sides.where(F.hypot(dx, dy) > 0).join(own, "cell", "left").groupBy(*keys).agg(F.array_sort(F.collect_list(taken)).alias("taken"))
    # what is open lies between the furthest end so far and the next beginning
    state = F.struct(F.lit(0.0).alias("at"), F.array().cast("array<struct<a:double,b:double>>").alias("open"))
    step = lambda s, t: F.struct(F.greatest(s["at"], t["b"]).alias("at"), F.when(t["a"] > s["at"], F.concat(s["open"], F.array(F.struct(s["at"].alias("a"), t["a"].alias("b"))))).otherwise(s["open"]).alias("open"))
    end = lambda s: F.when(s["at"] < 1.0, F.concat(s["open"], F.array(F.struct(s["at"].alias("a"), F.lit(1.0).alias("b"))))).otherwise(s["open"])
    free = met.select(*keys, F.explode(F.aggregate("taken", state, step, end)).alias("o")).where((F.col("o.b") - F.col("o.a")) * F.hypot(dx, dy) >= least)
    at = lambda c, d, t: F.col(c) + d * F.col(t)
    lines = free.select("cell", "level", "role", "side", at("ax", dx, "o.a").alias("ax"), at("ay", dy, "o.a").alias("ay"), at("ax", dx, "o.b").alias("bx"), at("ay", dy, "o.b").alias("by"))
    base = F.concat_ws("_", F.lit("CB"), F.col("level"), F.when(F.col("role") == "exterior_anchor", "ANCHOR").otherwise("OUTER"), compact_cell(F.col("cell")))
    n = F.row_number().over(Window.partitionBy("base").orderBy("side", "ax", "ay"))
    named = lines.withColumn("base", base).withColumn("n", n)
    return named.select(F.when(F.col("n") == 1, F.col("base")).otherwise(numbered(F.concat("base", F.lit("_")), F.col("n"), 2)).alias("boundary"), "cell", "role", "ax", "ay", "bx", "by")


def level_extents(levels: DataFrame, cells_: DataFrame) -> DataFrame:
    """(level, x0, y0, x1, y1): the extent a level (id, extent, width, height) is given, else its canvas, else the box of its cells."""
    xs = lambda k: F.transform("ring", lambda p: F.get(p, F.lit(k)))
    box = cells_.groupBy("level").agg(F.min(F.array_min(xs(0))).alias("cx0"), F.min(F.array_min(xs(1))).alias("cy0"), F.max(F.array_max(xs(0))).alias("cx1"), F.max(F.array_max(xs(1))).alias("cy1"))
    given, canvas = F.col("extent").isNotNull(), (F.col("width") > 0) & (F.col("height") > 0)
    corner = lambda f, k: f(F.transform("extent", lambda p: F.get(p, F.lit(k))))
    pick = lambda own, drawn, cells: F.when(given, own).when(canvas, drawn).otherwise(F.col(cells))
    both = levels.join(box.withColumnRenamed("level", "id"), "id", "left")
    return both.select(
        F.col("id").alias("level"), pick(corner(F.array_min, 0), F.lit(0.0), "cx0").alias("x0"), pick(corner(F.array_min, 1), F.lit(0.0), "cy0").alias("y0"),
        pick(corner(F.array_max, 0), F.col("width"), "cx1").alias("x1"), pick(corner(F.array_max, 1), F.col("height"), "cy1").alias("y1"),
    )


def collection(kind: Column) -> Column:
    """The collection of a level that an authored line belongs to; unknown types are walls."""
    return F.when(kind == "salida", "exits").when(kind == "frontera_virtual", "virtual_boundaries").when(kind.isin("ventana", "ventana_practicable"), "windows").when(kind.isin("puerta_simple", "puerta_doble"), "doors").otherwise("walls")


def added_level(levels: DataFrame, name: str, height: float = 3.0) -> DataFrame:
    """``levels`` (id, name, order, elevation) and one more above them, its elevation its order times ``height``."""
    top = levels.agg((F.coalesce(F.max("order"), F.lit(-1)) + 1).alias("order"))
    new = top.select(numbered("LEVEL_", F.col("order"), 2).alias("id"), F.lit(name).alias("name"), F.col("order").cast(levels.schema["order"].dataType).alias("order"), (F.col("order") * height).cast("double").alias("elevation"))
    return levels.select("id", "name", "order", "elevation").unionByName(new)


def vertical_links(endpoints: DataFrame) -> DataFrame:
    """(connector, lower, upper, from_cell, to_cell): consecutive endpoints (connector, level_order, level, cell) of each connector."""
    by = Window.partitionBy("connector").orderBy("level_order")
    up = endpoints.withColumn("upper", F.lead("level").over(by)).withColumn("to_cell", F.lead("cell").over(by))
    return up.where("upper is not null").select("connector", F.col("level").alias("lower"), "upper", F.col("cell").alias("from_cell"), "to_cell")


#: Features whose levels one task looks through for rooms: levels are few bytes and much work, so their bytes would make too few tasks.
LEVEL_ROWS = 2_000


def detected_spaces(features: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(level, space, ring, area, status): rooms that the wall lines of a level enclose, minus its objects.

    A room that overlaps a previous one (level, space, ring) most, and by half at least,
    keeps its id. A level whose walls enclose nothing keeps what it had, with status open.
    """
    out = "level string, space string, ring array<array<double>>, area double, status string"

    def run(key: tuple, rows: pd.DataFrame, had: pd.DataFrame) -> pd.DataFrame:
        level = key[-1]
        walls = [tuple(_points(r)[:2]) for k, r in zip(rows["kind"], rows["ring"]) if k in WALLS]
        blocks = [x for k, r in zip(rows["kind"], rows["ring"]) if k == "object" for x in P.convex_parts(P.cleaned(_points(r)))]
        thick = [x for k, r, t in zip(rows["kind"], rows["ring"], rows["thickness"]) if k in WALLS and (x := P.band(*_points(r)[:2], t or 0.1))]
        old = [(s, P.convex_parts(c)) for s, r in zip(had["space"], had["ring"]) if (c := P.cleaned(_points(r)))]
        rings, _ = P.faces(walls)
        made = [(level, s, [list(p) for p in _points(r)], abs(P.area(_points(r))), "open") for s, r in zip(had["space"], had["ring"])] if not rings else []
        free, used = {s for s, _ in old}, len(old)
        for ring in rings:
            parts = P.merged(P.difference(P.convex_parts(ring), blocks + thick))
            for part in parts:
                rated = sorted(((P.iou([part], o), s) for s, o in old if s in free), reverse=True)
                if rated and rated[0][0] >= 0.5:
                    name = rated[0][1]
                    free.discard(name)
                else:
                    used += 1
                    name = f"SPACE_{level}_{used:03d}"
                made.append((level, name, [list(p) for p in part], abs(P.area(part)), "ok"))
        return _named(rows, key, out, made)

    if previous is None:
        previous = features.sparkSession.createDataFrame([], _schema(features, "level string, space string, ring array<array<double>>"))
    n = tasks(features, LEVEL_ROWS)
    features, previous = (df.repartition(n, *_by(df)) for df in (features, previous))
    return features.groupBy(*_by(features)).cogroup(previous.groupBy(*_by(previous))).applyInPandas(run, _schema(features, out))


def history(snapshots: DataFrame, version: int) -> DataFrame:
    """The state at a version of append-only snapshots (version, key, value, deleted): undo is an earlier version."""
    last = snapshots.where(F.col("version") <= version).groupBy("key").agg(F.max_by(F.struct("value", "deleted"), "version").alias("s"))
    return last.where("not coalesce(s.deleted, false)").select("key", "s.value")
