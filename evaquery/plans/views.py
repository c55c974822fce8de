"""Graph views derived from cells and boundaries: adjacency, connectivity, doors, levels.

Cells are (cell, level, navigation_type, category, traversable, x, y, ring), boundaries
(boundary, a, b, is_virtual, role, traversable, ax, ay, bx, by). Edges are unordered: u < v.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import polygon as P
from ..operators.aggregates import merged_contacts
from ..operators.windows import global_row_number
from ..sources.storage import stored
from .graph import components

DOORS = ("Door", "Exit")
PASSAGES = ("Door", "Exit", "Stair", "Ramp", "Elevator")


def general(cells: DataFrame) -> DataFrame:
    return cells.where("navigation_type = 'GeneralSpace'")


def _members(cells: DataFrame, bounds: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(via, cell, traversable): general cells and the cells of ``kinds`` they touch."""
    both = bounds.select("boundary", F.col("a").alias("via"), F.col("b").alias("cell")).union(bounds.select("boundary", F.col("b").alias("via"), F.col("a").alias("cell")))
    via = cells.where(F.col("navigation_type").isin(*kinds)).select(F.col("cell").alias("via"), "category", F.coalesce("traversable", F.lit(True)).alias("traversable"))
    return both.join(via, "via").join(general(cells).select("cell"), "cell", "left_semi").select("via", "cell", "category", "traversable").distinct()


def _pairs(members: DataFrame, kind: str) -> DataFrame:
    a, b = members.select("via", F.col("cell").alias("u"), "traversable"), members.select("via", F.col("cell").alias("v"))
    return a.join(b, "via").where("u < v").select("u", "v", F.col("via").alias("boundary"), F.lit(kind).alias("kind"), "traversable")


def _direct(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    g = general(cells).select("cell")
    own = bounds.join(g.withColumnRenamed("cell", "a"), "a", "left_semi").join(g.withColumnRenamed("cell", "b"), "b", "left_semi")
    return own.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "boundary", F.when(F.col("is_virtual"), "virtual").otherwise("direct").alias("kind"), "traversable")


def numbered(edges: DataFrame, prefix: str) -> DataFrame:
    """Edges with ids in order of their ends."""
    text = F.col("n").cast("string")
    return global_row_number(edges, "u", "v").withColumn("edge", F.concat(F.lit(f"{prefix}_"), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))).drop("n")


def base_dual(cells: DataFrame, bounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    return cells.select(F.col("cell").alias("node"), "level", "x", "y"), bounds.select("boundary", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "traversable")


def space_adjacency(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """General cells that touch, or that share a transfer."""
    return numbered(merged_contacts(_direct(cells, bounds).unionByName(_pairs(_members(cells, bounds, ("TransferSpace",)), "transfer"))), "SAG")


def rooms(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """(cell, room): general cells merged through virtual boundaries; a room is named by its least cell."""
    g = general(cells).select("cell")
    code = stored(global_row_number(g, "cell", name="node"))
    link = bounds.where("is_virtual").join(code.select(F.col("cell").alias("a"), F.col("node").alias("u")), "a").join(code.select(F.col("cell").alias("b"), F.col("node").alias("v")), "b")
    root = components(code, link).join(code, "node").select("cell", "root")
    return root.join(code.select(F.col("node").alias("root"), F.col("cell").alias("room")), "root").select("cell", "room")


def room_nodes(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """(room, level, cells): one node a room with its member cells."""
    return rooms(cells, bounds).join(cells.select("cell", "level"), "cell").groupBy("room").agg(F.min("level").alias("level"), F.sort_array(F.collect_list("cell")).alias("cells"))


def room_adjacency(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rooms that touch, share a transfer or connector, or stand on two sides of a wall."""
    via = _members(cells, bounds, ("TransferSpace",))
    connector = F.col("category").isin("Stair", "Ramp", "Elevator")
    walls = _members(cells, bounds, ("NonNavigableSpace",)).withColumn("traversable", F.lit(False))
    found = _direct(cells, bounds).where("kind = 'direct'").unionByName(_pairs(via.where(~connector), "transfer")).unionByName(_pairs(via.where(connector), "connector")).unionByName(_pairs(walls, "wall"))
    r = rooms(cells, bounds)
    by_room = found.join(r.select(F.col("cell").alias("u"), F.col("room").alias("ru")), "u").join(r.select(F.col("cell").alias("v"), F.col("room").alias("rv")), "v")
    return numbered(merged_contacts(by_room.where("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v"), "boundary", "kind", "traversable")), "RADJ")


def room_to_room(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """Room pairs with a transfer or connector that lets pass."""
    via = F.array_contains("kinds", "transfer") | F.array_contains("kinds", "connector")
    return room_adjacency(cells, bounds).where(via & F.col("traversable")).withColumn("edge", F.regexp_replace("edge", "^RADJ", "R2R"))


def space_connectivity(cells: DataFrame, bounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): cells and one node a virtual boundary; edges across virtual boundaries and through open transfers."""
    soft = bounds.where("is_virtual")
    own = cells.where("navigation_type in ('GeneralSpace', 'TransferSpace')").select(F.col("cell").alias("node"), "navigation_type")
    nodes = own.unionByName(soft.select(F.concat(F.lit("VTN_"), "boundary").alias("node"), F.lit("VirtualTransferNode").alias("navigation_type")))
    over = soft.select("boundary", F.explode(F.array("a", "b")).alias("u"), F.concat(F.lit("VTN_"), "boundary").alias("v"))
    through = bounds.where("role = 'general_transfer_contact'").select("boundary", F.col("a").alias("u"), F.col("b").alias("v"))
    return nodes, over.unionByName(through).select("boundary", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def _transfer_pairs(cells: DataFrame, bounds: DataFrame, categories: tuple[str, ...] | None, virtual: bool, blocked: bool, prefix: str) -> DataFrame:
    """Pairs of transfers of one space with the way between them inside it."""
    t = cells.where("navigation_type = 'TransferSpace'").select(F.col("cell").alias("transfer"), "category", F.coalesce("traversable", F.lit(True)).alias("open"), "x", "y")
    if categories:
        t = t.where(F.col("category").isin(*categories))
    if not blocked:
        t = t.where("open")
    sides = bounds.select("a", "b", "ax", "ay", "bx", "by")
    touching = sides.select(F.col("a").alias("transfer"), F.col("b").alias("space"), "ax", "ay", "bx", "by").union(sides.select(F.col("b").alias("transfer"), F.col("a").alias("space"), "ax", "ay", "bx", "by"))
    at = touching.join(t, "transfer").select("space", "transfer", ((F.col("ax") + F.col("bx")) / 2).alias("px"), ((F.col("ay") + F.col("by")) / 2).alias("py"))
    if virtual:
        v = bounds.where("is_virtual").select(F.explode(F.array("a", "b")).alias("space"), F.concat(F.lit("VTN_"), "boundary").alias("transfer"), ((F.col("ax") + F.col("bx")) / 2).alias("px"), ((F.col("ay") + F.col("by")) / 2).alias("py"))
        at = at.unionByName(v)
    at = at.join(general(cells).select(F.col("cell").alias("space"), "ring"), "space").dropDuplicates(["space", "transfer"])
    a, b = at.select("space", "ring", F.col("transfer").alias("u"), F.col("px").alias("ux"), F.col("py").alias("uy")), at.select("space", F.col("transfer").alias("v"), F.col("px").alias("vx"), F.col("py").alias("vy"))
    pairs = a.join(b, "space").where("u < v")

    @F.pandas_udf("double")
    def way(ring: pd.Series, ux: pd.Series, uy: pd.Series, vx: pd.Series, vy: pd.Series) -> pd.Series:
        return pd.Series([round(P.inner_distance([tuple(p) for p in r], (a, b), (c, d)), 6) for r, a, b, c, d in zip(ring, ux, uy, vx, vy)], dtype=float)

    return numbered(pairs.select("space", "u", "v", way("ring", "ux", "uy", "vx", "vy").alias("distance")), prefix)


def transfer_to_transfer(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    return _transfer_pairs(cells, bounds, None, True, True, "T2T")


def door_to_door(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    return _transfer_pairs(cells, bounds, DOORS, False, False, "D2D")


def vertical_connectivity(cells: DataFrame, links: DataFrame, bounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of connectors: their cells, contacts among them, links between levels."""
    own = cells.where(F.col("category").isin("Stair", "Ramp", "Elevator"))
    c = own.select("cell")
    flat = bounds.join(c.withColumnRenamed("cell", "a"), "a", "left_semi").join(c.withColumnRenamed("cell", "b"), "b", "left_semi").select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit("flat").alias("kind"))
    up = links.select(F.col("from_cell").alias("u"), F.col("to_cell").alias("v"), F.lit("vertical").alias("kind"))
    return own.select(F.col("cell").alias("node"), "level", "category"), flat.unionByName(up)


VIEWS = {
    "base_dual": base_dual, "space_adjacency": space_adjacency, "general_space_adjacency": space_adjacency, "room_adjacency": room_adjacency, "room_to_room": room_to_room, "room_to_room_accessibility": room_to_room,
    "space_connectivity": space_connectivity, "space_transfer_connectivity": space_connectivity, "room_transfer_connectivity": space_connectivity, "transfer_to_transfer": transfer_to_transfer, "door_to_door": door_to_door,
}
