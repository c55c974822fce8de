"""Masks, predicates and selections over nodes, edges and matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The layers that can be asked for; a group stands for its members.
LAYERS = {
    "source": ("source",), "general": ("general",), "transfer": ("transfer",), "non_navigable": ("non_navigable",), "object": ("object",),
    "navigable_boundaries": ("navigable_boundaries",), "non_navigable_boundaries": ("non_navigable_boundaries",), "nodes": ("nodes",), "edges": ("edges",),
    "cells": ("general", "transfer", "non_navigable", "object"), "boundaries": ("navigable_boundaries", "non_navigable_boundaries"), "dual": ("nodes", "edges"),
    "all": ("source", "general", "transfer", "non_navigable", "object", "navigable_boundaries", "non_navigable_boundaries", "nodes", "edges"),
}
#: Named views, each a list of layers and a graph view.
PRESETS = {
    "basic": ("general,transfer", None),
    "spaces": ("general,transfer,object,non_navigable", None),
    "navigable-boundaries": ("general,transfer,navigable_boundaries", None),
    "non-navigable": ("non_navigable,object", None),
    "overlaps": ("general,transfer,object,non_navigable", None),
    "graph-base-dual": ("cells", "base_dual"),
    "graph-space-adjacency": ("general,navigable_boundaries", "space_adjacency"),
    "graph-space-connectivity": ("general,transfer,navigable_boundaries", "space_connectivity"),
    "graph-room-adjacency": ("general,transfer,non_navigable", "room_adjacency"),
    "graph-room-to-room": ("general,transfer", "room_to_room_accessibility"),
    "graph-room-transfer": ("general,transfer,navigable_boundaries", "space_connectivity"),
    "graph-transfer-to-transfer": ("general,transfer,navigable_boundaries,non_navigable_boundaries", "transfer_to_transfer"),
    "graph-door-to-door": ("general,transfer", "door_to_door"),
    "graph-vertical": ("transfer", "vertical_connectivity"),
    "graph-multilevel-vertical": ("general,transfer", "vertical_connectivity"),
}


def optional_equal(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows where each named column equals its value; a value of None asks for nothing."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def mobility_allowed(allowed: tuple[str, ...], general_without: bool = True) -> Column:
    """Locomotion is allowed, or there is none and the space is general and that may pass."""
    known = F.coalesce(F.col("locomotion").isin(*allowed), F.lit(False))
    return known | (F.lit(general_without) & F.col("locomotion").isNull() & (F.col("kind") == "GENERAL"))


def safe(threshold: float, score: str = "score") -> Column:
    """A missing score counts as safe."""
    return F.coalesce(F.col(score), F.lit(1.0)) >= threshold


def is_exit() -> Column:
    return F.coalesce(F.col("is_exit"), F.lit(False)) | F.upper("function_code").isin("EXIT", "EMERGENCY_EXIT")


def is_last_resort() -> Column:
    return F.upper("function_code").isin("WINDOW", "VENTANA")


def positive(edges: DataFrame) -> DataFrame:
    return edges.where("weight is not null and weight > 0")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among ``nodes`` (column node)."""
    ends = nodes.select("node")
    return edges.join(ends.withColumnRenamed("node", "u"), "u", "left_semi").join(ends.withColumnRenamed("node", "v"), "v", "left_semi").select(*edges.columns)


def masked_matrix(entries: DataFrame, allowed: DataFrame) -> DataFrame:
    """(i, j, w) with rows and columns of other nodes set to zero, the shape kept."""
    ok = allowed.select("node").distinct()
    one = entries.join(ok.select(F.col("node").alias("i"), F.lit(True).alias("oi")), "i", "left").join(ok.select(F.col("node").alias("j"), F.lit(True).alias("oj")), "j", "left")
    return one.select("i", "j", F.when(F.col("oi") & F.col("oj"), F.col("w")).otherwise(0).alias("w"))


def safety_cut(costs: DataFrame, safety: DataFrame, least: float) -> DataFrame:
    """(i, j, cost) with cost zero where (i, j, safety) is below ``least``; entry by entry, not symmetrised."""
    both = costs.join(safety, ["i", "j"], "left")
    return both.select("i", "j", F.when(F.coalesce("safety", F.lit(1.0)) < least, 0).otherwise(F.col("cost")).alias("cost"))


def without_banned(edges: DataFrame, nodes: DataFrame, needed: str = "Rolling") -> DataFrame:
    """Edges that neither touch nor pass through (column context) a node whose locomotion lacks ``needed``."""
    banned = nodes.where(~F.array_contains("locomotion_list", needed)).select("node")
    for end in ("u", "v", "context"):
        edges = edges.join(banned.withColumnRenamed("node", end), end, "left_anti")
    return edges


def layers_of(selection: str) -> set[str]:
    """The layers that a comma list names, groups expanded; none named means all, unknown names raise."""
    out: set[str] = set()
    for name in filter(None, (x.strip().lower() for x in selection.split(","))):
        if name not in LAYERS:
            raise ValueError(f"unknown layer {name}")
        out |= set(LAYERS[name])
    return out or set(LAYERS["all"])


def preset(name: str) -> tuple[set[str], str | None]:
    """(layers, graph view) of a named view."""
    layers, view = PRESETS[name]
    return layers_of(layers), view


def layer_of_cell() -> Column:
    kind = F.col("navigation_type")
    return F.when(kind == "GeneralSpace", "general").when(kind == "TransferSpace", "transfer").when(kind == "ObjectSpace", "object").otherwise("non_navigable")


def in_layers(cells: DataFrame, selection: str) -> DataFrame:
    return cells.where(layer_of_cell().isin(*layers_of(selection)))


def transfer_is_open() -> Column:
    """Not closed by default, and of a kind one can pass."""
    return F.coalesce(F.col("default_traversable"), F.lit(True)) & F.coalesce(F.col("category").isin("Door", "Exit", "Stair", "Ramp", "Elevator"), F.lit(False))


def connector_id() -> Column:
    return F.when(F.col("category").isin("Stair", "Ramp", "Elevator"), F.col("connector_id"))


def is_wall_cell() -> Column:
    return (F.col("navigation_type") == "NonNavigableSpace") & (F.col("function") == "Wall") & F.col("category").isin("WallSegment", "WallJunction")


def colliders(walls: DataFrame) -> DataFrame:
    """One row: how many outer and inner walls there are to collide with."""
    return walls.agg(F.count_if(F.col("tipo") == "muro_exterior").alias("exterior"), F.count_if(F.col("tipo") == "muro_interior").alias("interior"))


def without_closed(edges: DataFrame, door_states: DataFrame) -> DataFrame:
    """Edges whose door's latest state (u, v, ts, state) is not closed."""
    latest = door_states.groupBy("u", "v").agg(F.max_by("state", "ts").alias("state"))
    return edges.join(latest.where("state = 'closed'"), ["u", "v"], "left_anti")


def forced(nodes: DataFrame, sources: DataFrame, allowed: tuple[str, ...], threshold: float) -> DataFrame:
    """Nodes with kept (mask, or an agent stands there) and the reason of what the mask dropped."""
    here = sources.select("node", F.lit(True).alias("here")).distinct()
    moves, sure = mobility_allowed(allowed), safe(threshold)
    reason = F.when(~moves, "mobility").when(~sure, "score")
    return nodes.join(here, "node", "left").select("node", (moves & sure | F.coalesce("here", F.lit(False))).alias("kept"), reason.alias("reason"))
