"""Connected components of a link table, by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every end of ``links`` (a, b), bigint or binary.

    Each round every node points to its neighbour of least random rank (the rank is a
    hash of node and round) unless its own rank is less; links are rewritten to the
    pointed-to nodes, loops and repeats go. The node of greatest rank of a component
    always disappears and chains shrink by a constant factor, so rounds grow with the
    logarithm of the longest path. Groups of any size are only ever reduced by ``min``
    before a shuffle. Nulls and self-links are ignored; no links give no rows.
    """
    pairs = links.where("a is not null and b is not null and a <> b")
    edges = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, turn = None, 0
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("r"), F.col(c).alias("n"))  # noqa: B023,E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy("a").agg(F.min(rank("b")).alias("best")).select(F.col("a").alias("n"), F.least("best", rank("a")).getField("n").alias("p")))
        if labels is None:
            labels = parent.select(F.col("n").alias("node"), F.col("p").alias("root"))
        else:
            labels = stored(labels.join(parent, F.col("root") == F.col("n"), "left").select("node", F.coalesce("p", "root").alias("root")))
        moved = edges.join(parent.select(F.col("n").alias("a"), F.col("p").alias("pa")), "a").join(parent.select(F.col("n").alias("b"), F.col("p").alias("pb")), "b")
        edges = stored(moved.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        turn += 1
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels
