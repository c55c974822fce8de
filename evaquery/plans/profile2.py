"""The newer map document (version 2): spaces, boundaries, graphs and spawn points of many models at once.

Spaces are (model, name, x, y, ring, klass, category, locomotion), links (model, index,
origen, destino, tipo, contexto) with their place in the model's list, from 1 on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shapes
from ..functions.ids import numbered, prefixed
from ..functions.scalars import connector_type, node_type, space_class, through_space
from .reexport import snapshot

#: Link types, and the graph each makes: its name, id, and the prefixes of nodes and edges.
GRAPHS = {
    "adyacencia_fisica": ("adjacency_graph", "GRAPH_ADJ_LEVEL_00", "N_ADJ", "E_ADJ"),
    "navegable_puerta": ("connectivity_graph", "GRAPH_CONN_LEVEL_00", "N_CONN", "E_CONN"),
    "door_to_door": ("door_to_door_graph", "GRAPH_D2D_LEVEL_00", "N_D2D", "E_D2D"),
}
LEVEL = "LEVEL_00"


def _by_type(tipo: Column, part: int) -> Column:
    out = F.lit(None).cast("string")
    for name, values in GRAPHS.items():
        out = F.when(tipo == name, values[part]).otherwise(out)
    return out


def locomotion(values: Column) -> Column:
    """Lower-case names, each once, in their order; synonyms stay apart."""
    own = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v)))
    return F.array_distinct(F.filter(own, lambda v: v != ""))


def profiles(a: Column, b: Column) -> Column:
    """Who may pass between two spaces: what both allow, else the one that says, else walkers."""
    walkers = F.array(F.lit("walking"))
    both = F.filter(a, lambda v: F.array_contains(b, v))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.when(F.size(both) > 0, both).otherwise(walkers)).when(F.size(a) > 0, a).when(F.size(b) > 0, b).otherwise(walkers)


def spaces(own: DataFrame) -> DataFrame:
    kind = space_class(F.col("name"), F.col("klass"), F.col("category"))
    return own.where("x is not null and size(ring) > 0").select("model", prefixed("SPACE", F.col("name")).alias("space_id"), F.lit(LEVEL).alias("level_id"), "name", kind.alias("c"), "x", "y", "ring", locomotion(F.col("locomotion")).alias("locomotion")).select(
        "model", "space_id", "level_id", F.col("c.type").alias("space_type"), "name", F.col("c.category").alias("category"), F.col("c.function").alias("function"), "x", "y", "ring", "locomotion"
    )


def _linked(links: DataFrame, made: DataFrame) -> DataFrame:
    """Links both of whose ends are spaces, with both."""
    side = lambda name, p: made.select("model", F.col("name").alias(name), *[F.col(c).alias(f"{p}{c}") for c in ("space_id", "x", "y", "ring", "locomotion")])
    return links.join(side("origen", "a_").hint("merge"), ["model", "origen"]).join(side("destino", "b_").hint("merge"), ["model", "destino"])


def boundaries(links: DataFrame, made: DataFrame) -> DataFrame:
    """One for each link through a door: the border the two share, or the line between their middles, marked approximate.

    Numbered by the link's place in the whole list.
    """
    own = _linked(links.where("tipo = 'navegable_puerta'"), made)
    line = own.withColumn("contact", shapes.contact(F.col("a_ring"), F.col("b_ring")))
    between = F.array("a_x", "a_y", "b_x", "b_y")
    special = (node_type(F.col("origen")) == "virtual_boundary") | F.lower("origen").contains("frontera") | F.lower("destino").contains("frontera")
    return line.select(
        "model", numbered("BOUNDARY_NAV_", F.col("index"), 3).alias("boundary_id"), F.lit(LEVEL).alias("level_id"), F.when(special, "special_boundary").otherwise("navigable_boundary").alias("boundary_type"), F.col("a_space_id").alias("source_space_id"),
        F.col("b_space_id").alias("target_space_id"), F.coalesce("contact", between).alias("line"), F.col("contact").isNull().alias("approximate"), "origen", "destino",
    )


def graph_nodes(links: DataFrame, made: DataFrame) -> DataFrame:
    """The spaces that links of each type join, once a graph."""
    ends = _linked(links, made).select("model", "tipo", F.explode(F.array("origen", "destino")).alias("name")).where(_by_type(F.col("tipo"), 0).isNotNull()).distinct()
    both = ends.join(made.select("model", "name", "space_id", "x", "y").hint("merge"), ["model", "name"])
    name = F.col("name")
    return both.select("model", _by_type(F.col("tipo"), 0).alias("graph"), F.concat_ws("_", _by_type(F.col("tipo"), 2), F.regexp_replace(prefixed("", name), "^_", "")).alias("node_id"), F.col("space_id").alias("space_ref"), node_type(name).alias("node_type"), F.lit(LEVEL).alias("level_id"), "x", "y")


def graph_edges(links: DataFrame, made: DataFrame) -> DataFrame:
    """The links of each type as edges, numbered in their order within the graph, each with what its type says of it."""
    own = _linked(links, made).where(_by_type(F.col("tipo"), 0).isNotNull())
    n = F.row_number().over(Window.partitionBy("model", "tipo").orderBy("index"))
    through = through_space(F.col("origen"), F.col("destino"))
    room = F.when(F.col("tipo") == "navegable_puerta", through).when(F.col("tipo") == "door_to_door", F.col("contexto"))
    door, open_ = F.col("tipo") == "navegable_puerta", F.col("tipo") != "adyacencia_fisica"
    node = lambda c: F.concat_ws("_", _by_type(F.col("tipo"), 2), F.regexp_replace(prefixed("", F.col(c)), "^_", ""))
    far = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y"))
    kind = connector_type(F.col("origen"), F.col("destino"))
    flows = F.when(kind == "emergency_exit", F.array(F.lit("pedestrian"), F.lit("emergency_exit"))).otherwise(F.array(F.lit("pedestrian")))
    known = made.select("model", F.col("name").alias("room"), F.col("space_id").alias("through_space_id"))
    edges = own.withColumn("n", n).withColumn("room", room).join(known.hint("merge"), ["model", "room"], "left")
    return edges.select(
        "model", _by_type(F.col("tipo"), 0).alias("graph"), F.concat(_by_type(F.col("tipo"), 3), numbered("_", F.col("n"), 3)).alias("edge_id"), node("origen").alias("source_node_id"), node("destino").alias("target_node_id"), far.alias("distance_m"),
        F.when(F.col("tipo") == "adyacencia_fisica", "physical_adjacency").when(F.col("tipo") == "door_to_door", "door_to_door").alias("relationship_type"), F.when(door, kind).alias("connector_type"), F.when(door, flows).alias("allowed_flows"),
        F.when(open_, profiles(F.col("a_locomotion"), F.col("b_locomotion"))).alias("allowed_profiles"), F.when(open_, far).alias("base_weight"), F.when(open_, F.col("through_space_id")).alias("through_space_id"),
        F.when(door, numbered("BOUNDARY_NAV_", F.col("index"), 3)).alias("boundary_ref"), F.when(F.col("tipo") == "door_to_door", 1).alias("capacity_persons"),
    )


def spawns(points: DataFrame, made: DataFrame) -> DataFrame:
    """Spawn points (model, index, x, y) with the space they are in, its border included; the first space, marked, where they are in none.

    Joined by shuffle: of how many rows the spaces have Spark's estimate knows nothing.
    """
    ends = made.select("model", "space_id", F.transform("ring", lambda p: F.get(p, F.lit(0))).alias("xs"), F.transform("ring", lambda p: F.get(p, F.lit(1))).alias("ys"))
    boxes = ends.select("model", "space_id", F.array_min("xs").alias("x0"), F.array_max("xs").alias("x1"), F.array_min("ys").alias("y0"), F.array_max("ys").alias("y1"))
    inside = points.join(boxes.hint("merge"), "model").where("x between x0 and x1 and y between y0 and y1").groupBy("model", "index").agg(F.min("space_id").alias("space"))
    first = made.groupBy("model").agg(F.min("space_id").alias("first"))
    both = points.join(inside.hint("merge"), ["model", "index"], "left").join(first.hint("merge"), "model", "left")
    return both.select("model", numbered("SPAWN_", F.col("index"), 3).alias("spawn_id"), F.lit(LEVEL).alias("level_id"), F.coalesce("space", "first", F.lit("UNKNOWN_SPACE")).alias("space_ref"), "x", "y", F.col("space").isNull().alias("inferred"))


def document(own: DataFrame, links: DataFrame, points: DataFrame) -> DataFrame:
    """(model, value): the document of every model, its collections as JSON without nulls."""
    made = spaces(own)
    return snapshot("model", spaces=made, boundaries=boundaries(links, made), graph_nodes=graph_nodes(links, made), graph_edges=graph_edges(links, made), agent_spawns=spawns(points, made))
