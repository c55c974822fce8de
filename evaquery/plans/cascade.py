"""The rebuild cascade keyed by what changed: cells -> boundaries -> nodes -> edges, region by region.

A region is a square of the floor, the same on all levels. A boundary belongs to the
region of the low corner of its line, a node to that of its cell's low corner, an edge to
its boundary's. What a region holds depends only on the cells whose boxes touch it, so a
change of cells dirties the regions that their old and new boxes touch and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import boundary_key
from ..sources.storage import stored
from . import topology

SIZE = 256
#: Regions that a scan's filter names at most.
NAMED = 1000
BOX = ("level", "x0", "y0", "x1", "y1")
KINDS = ("boundaries", "nodes", "edges")


def region(x: Column, y: Column, size: int) -> list[Column]:
    return [F.floor(x / size).cast("long").alias("rx"), F.floor(y / size).cast("long").alias("ry")]


def touched(boxes: DataFrame, size: int) -> DataFrame:
    """``boxes`` with a row for each region (rx, ry) that a closed box touches."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size).cast("long"), F.floor(F.col(b) / size).cast("long")))
    return boxes.withColumn("rx", span("x0", "x1")).withColumn("ry", span("y0", "y1"))


def dirty_regions(old: DataFrame, new: DataFrame, size: int = SIZE) -> DataFrame:
    """(rx, ry): regions touched by a cell that came, went, or changed its box or level, where it was and where it is."""
    side = lambda df, name: df.select("cell", F.struct(*BOX).alias(name))
    both = side(old, "was").join(side(new, "is"), "cell", "full").where(~F.col("was").eqNullSafe(F.col("is")))
    boxes = both.select(F.explode(F.array("was", "is")).alias("b")).where("b is not null").select("b.*")
    return touched(boxes, size).select("rx", "ry").distinct()


def derived(cells: DataFrame, size: int = SIZE, dirty: DataFrame | None = None) -> dict[str, DataFrame]:
    """boundaries (boundary_key, level, a, b, length), nodes (node_id, cell, x, y) and edges (boundary, u, v, weight),
    each with its region, of all regions or of the ``dirty`` ones alone."""
    if dirty is None:
        own = mine = cells
        inside = lambda df: df
    else:
        near = touched(cells.select("cell", *BOX), size).join(F.broadcast(dirty), ["rx", "ry"], "left_semi")
        own = stored(near.drop("rx", "ry").distinct())
        inside = lambda df: df.join(F.broadcast(dirty), ["rx", "ry"], "left_semi")
        mine = own.select("*", *region(F.col("x0"), F.col("y0"), size)).join(F.broadcast(dirty), ["rx", "ry"], "left_semi")
    met = topology.contacts(own).select("*", *region(F.col("x0"), F.col("y0"), size))
    keyed = inside(met).withColumn("boundary_key", boundary_key(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    bounds = stored(keyed.groupBy("boundary_key", "level", "rx", "ry").agg(F.min(F.struct("a", "b", "length")).alias("m")).select("boundary_key", "level", "m.a", "m.b", "m.length", "rx", "ry"))
    corner = mine.select("cell", *region(F.col("x0"), F.col("y0"), size))
    nodes = topology.node_rows(mine).join(corner, "cell").select("node_id", "cell", "x", "y", "rx", "ry")
    edges = topology.edge_rows(topology.membership(bounds), topology.node_rows(own))
    place = bounds.groupBy(F.col("boundary_key").alias("boundary")).agg(F.min("rx").alias("rx"), F.min("ry").alias("ry"))
    return {"boundaries": bounds, "nodes": nodes, "edges": edges.join(place, "boundary").select("boundary", "u", "v", "weight", "rx", "ry")}


def cascaded(old: DataFrame, new: DataFrame, have: dict[str, DataFrame], size: int = SIZE) -> dict[str, DataFrame]:
    """What ``derived`` gives for ``new`` cells, made of what it gave for ``old`` ones (``have``).

    Rows of dirty regions go, by an anti join, and are derived anew from the cells that touch
    them; all others stay as they are. Dirty regions are broadcast: they are no more than
    the changed cells touch. Both rebuilds give the same rows.
    """
    dirty = stored(dirty_regions(old, new, size))
    fresh = derived(new, size, dirty)
    return {k: have[k].join(F.broadcast(dirty), ["rx", "ry"], "left_anti").select(fresh[k].columns).unionByName(fresh[k]) for k in KINDS}


class TopologyStore:
    """Cells and what is derived of them, in folders by region; a change rewrites the folders of its dirty regions.

    Cells lie in every region they touch, so a region is rebuilt from its own folders.
    Reads name the regions, so a scan lists and reads their folders alone. A write replaces
    whole regions by Spark's dynamic partition overwrite; a batch that is run again
    replaces them by the same rows. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, size: int = SIZE) -> None:
        self.spark, self.path, self.size = spark, path, size

    def _write(self, name: str, df: DataFrame) -> None:
        named = df.withColumn("region", F.concat_ws("_", "rx", "ry")).repartition("region")
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region").parquet(f"{self.path}/{name}")

    def _schema(self, name: str) -> str:
        return {
            "cells": "cell bigint, level int, x0 int, y0 int, x1 int, y1 int, rx bigint, ry bigint, region string",
            "boundaries": "boundary_key string, level int, a bigint, b bigint, length int, rx bigint, ry bigint, region string",
            "nodes": "node_id string, cell bigint, x double, y double, rx bigint, ry bigint, region string",
            "edges": "boundary string, u bigint, v bigint, weight double, rx bigint, ry bigint, region string",
        }[name]

    def read(self, name: str, regions: DataFrame | None = None) -> DataFrame:
        """A table whole, or what it holds of ``regions`` (rx, ry). Up to NAMED regions are named in a filter on the
        folders' own column, so no other folder is listed or read; more are joined with the scan."""
        table = self.spark.read.schema(self._schema(name)).parquet(f"{self.path}/{name}")
        if regions is not None:
            wanted = regions.select(F.concat_ws("_", "rx", "ry").alias("region"))
            named = [r["region"] for r in wanted.limit(NAMED + 1).collect()]
            table = table.where(F.col("region").isin(named)) if len(named) <= NAMED else table.join(F.broadcast(wanted), "region", "left_semi")
        return table.drop("region")

    def create(self, cells: DataFrame) -> None:
        own = stored(cells.select("cell", *BOX))
        self._write("cells", touched(own, self.size))
        for name, df in derived(own, self.size).items():
            self._write(name, df)

    def change(self, changes: DataFrame) -> DataFrame:
        """Takes ``changes`` (cell, level, x0, y0, x1, y1, gone): new and moved cells, and gone ones by their id; returns the dirty regions.

        Where a cell was is looked up by its id over the cells of all regions. The cells are written last, so a
        change that failed on its way finds them as they were and does all of it again.
        """
        own = stored(changes.select("cell", *BOX, "gone"))
        was = self.read("cells").join(F.broadcast(own.select("cell")), "cell", "left_semi").select("cell", *BOX).distinct()
        dirty = stored(dirty_regions(was, own.where("not gone").drop("gone"), self.size))
        kept = self.read("cells", dirty).drop("rx", "ry").distinct().join(F.broadcast(own.select("cell")), "cell", "left_anti")
        cells = stored(kept.unionByName(own.where("not gone").drop("gone")))
        fresh = {name: stored(df) for name, df in derived(cells, self.size, dirty).items()}
        of = touched(cells, self.size).join(F.broadcast(dirty), ["rx", "ry"], "left_semi")
        for name, df in fresh.items():
            self._replace(name, df, dirty)
        self._replace("cells", stored(of), dirty)
        return dirty

    def _replace(self, name: str, rows: DataFrame, dirty: DataFrame) -> None:
        """Writes the regions that have rows and empties the dirty ones that have none."""
        self._write(name, rows)
        bare = dirty.join(rows.select("rx", "ry").distinct(), ["rx", "ry"], "left_anti").select(F.concat_ws("_", "rx", "ry").alias("region"))
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for (folder,) in bare.toLocalIterator():
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/region={folder}")
            at.getFileSystem(conf).delete(at, True)
