"""Aggregates of the domain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def noisy_or(weight: Column, severity: Column) -> Column:
    """1 - product of (1 - w s)."""
    return 1 - F.product(1 - weight * severity)


def steady_mean(value: Column) -> Column:
    """The mean of doubles that are short decimals, of at most nine places, from their exact sum, so one that is to be held
    against a bound does not depend on the order of its rows; the plain mean of a group with any other double."""
    short = value.try_cast("decimal(28,9)")
    exact = F.try_divide(F.try_sum(short).cast("double"), F.count(value))
    return F.coalesce(F.when(F.bool_and(short.cast("double").eqNullSafe(value)), exact), F.avg(value))


def two_sided(membership: DataFrame) -> DataFrame:
    """(boundary, a, b): boundaries that exactly two cells share."""
    return membership.groupBy("boundary").agg(F.min("cell").alias("a"), F.max("cell").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


def merged_contacts(contacts: DataFrame) -> DataFrame:
    """One row an unordered pair (u, v): its boundaries, kinds and whether any is traversable."""
    pair = contacts.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "boundary", "kind", "traversable")
    return pair.groupBy("u", "v").agg(F.sort_array(F.collect_set("boundary")).alias("boundaries"), F.sort_array(F.collect_set("kind")).alias("kinds"), F.bool_or("traversable").alias("traversable"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: sizes, density, weights and mean degree."""
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.min("weight").alias("min_w"), F.max("weight").alias("max_w"), F.round(F.avg("weight"), 6).alias("mean_w"))
    both = n.join(m, how="cross")
    density = F.round(2 * F.col("n_edges") / F.nullif(F.col("n_nodes") * (F.col("n_nodes") - 1), F.lit(0)), 6)
    return both.select("*", density.alias("density"), F.round(2 * F.col("n_edges") / F.nullif(F.col("n_nodes"), F.lit(0)), 6).alias("mean_degree"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): counts of equal bins of [low, high], its end in the last one."""
    at = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density(df: DataFrame, size: float) -> DataFrame:
    """(gx, gy, n): events on a grid."""
    return df.groupBy(F.floor(F.col("x") / size).cast("int").alias("gx"), F.floor(F.col("y") / size).cast("int").alias("gy")).agg(F.count(F.lit(1)).alias("n"))


def melted(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "measure", "value")


def path_scores(paths: DataFrame, scores: DataFrame) -> DataFrame:
    """(path_id, least, mean) of the scores along a path; a missing score is 1."""
    at = paths.select("path_id", F.explode("path").alias("node")).join(scores, "node", "left")
    own = F.coalesce("score", F.lit(1.0))
    return at.groupBy("path_id").agg(F.min(own).alias("least"), F.round(F.avg(own), 6).alias("mean"))


def geometric_agility(paths: DataFrame, centrality: DataFrame) -> DataFrame:
    """(path_id, agility): geometric mean of the centrality of a path's inner nodes; zero if one is zero."""
    inner = F.expr("slice(path, 2, greatest(size(path) - 2, 0))")
    at = paths.select("path_id", F.explode(inner).alias("node")).join(centrality, "node", "left")
    c = F.coalesce("c", F.lit(0.0))
    return at.groupBy("path_id").agg(F.when(F.min(c) <= 0, 0.0).otherwise(F.exp(F.avg(F.ln(c)))).alias("agility"))


def robust_share(flags: DataFrame) -> DataFrame:
    return flags.groupBy("path_id").agg(F.avg(F.col("robust").cast("double")).alias("share"))


def sizes(documents: DataFrame, **arrays: str) -> DataFrame:
    """Each document with the sizes of its array columns, by output name; a null array has none."""
    return documents.select(*[c for c in documents.columns if c not in arrays.values()], *[F.coalesce(F.size(a), F.lit(0)).cast("bigint").alias(name) for name, a in arrays.items()])


def document_counts(models: DataFrame, **arrays: str) -> DataFrame:
    """Total sizes of array columns over documents, by output name."""
    return models.agg(*[F.sum(F.coalesce(F.size(a), F.lit(0))).alias(name) for name, a in arrays.items()])


def member_counts(**members: DataFrame) -> DataFrame:
    """One row: how many rows each frame has, by name; a count each before anything moves."""
    kinds = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("kind")) for name, df in members.items()])
    return kinds.groupBy("kind").count().agg(*[F.coalesce(F.sum(F.when(F.col("kind") == name, F.col("count"))), F.lit(0)).alias(name) for name in members])


def distinct_routes(routes: DataFrame, *by: str) -> DataFrame:
    """(by, routes, distinct): how many routes (path) there are, and how many different ones."""
    return routes.groupBy(*by).agg(F.count(F.lit(1)).alias("routes"), F.countDistinct("path").alias("distinct"))


def run_totals(frames: DataFrame, *by: str) -> DataFrame:
    """(by, frames, replans, travelled, mean, longest) of frames (replan, length): what a run adds up to."""
    replans = F.count_if(F.coalesce("replan", F.lit(False)))
    return frames.groupBy(*by).agg(F.count(F.lit(1)).alias("frames"), replans.alias("replans"), F.round(F.sum("length"), 6).alias("travelled"), F.round(F.avg("length"), 6).alias("mean"), F.max("length").alias("longest"))


def largest(df: DataFrame, by: str, size: str, tie: str) -> DataFrame:
    """The row of greatest ``size`` for each ``by``, the least ``tie`` of equal ones: an aggregate, no window."""
    rest = [c for c in df.columns if c not in (by, size)]
    top = df.groupBy(by).agg(F.max(size).alias(size))
    best = df.join(top, [by, size]).groupBy(by, size).agg(F.min(F.struct(tie, *[c for c in rest if c != tie])).alias("b"))
    return best.select(by, size, *[F.col("b")[c].alias(c) for c in rest])


def shared_lines(contacts: DataFrame) -> DataFrame:
    """(cell, lines, length): the borders (a, b, x0, y0, x1, y1) a cell shares, as one, each line counted once."""
    line = F.struct("x0", "y0", "x1", "y1")
    both = contacts.select(F.explode(F.array("a", "b")).alias("cell"), line.alias("line")).distinct()
    long = F.hypot(F.col("line.x1") - F.col("line.x0"), F.col("line.y1") - F.col("line.y0"))
    return both.groupBy("cell").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum(long), 6).alias("length"))
