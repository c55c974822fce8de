"""Graph plans: relaxation, components and routes over edge tables of any size."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored

#: A graph of at most so many directed edges, counted first, goes whole to every task that
#: searches it (some megabytes); a larger one is relaxed over tables.
SMALL_GRAPH = 100_000


def symmetric(edges: DataFrame) -> DataFrame:
    """(u, v, weight) in both directions."""
    return edges.select("u", "v", "weight").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))


def _searched(both: DataFrame, sources: DataFrame) -> DataFrame:
    """``distances`` in a small graph: a search from each source, sources dealt over the tasks."""
    near: dict[int, list[tuple[int, float]]] = {}
    for u, v, w in both.collect():
        near.setdefault(u, []).append((v, float(w)))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for source in rows["node"].tolist():
                done, heap = set(), [(0.0, 0, source, source)]
                while heap:
                    cost, legs, before, node = heapq.heappop(heap)
                    if node in done:
                        continue
                    done.add(node)
                    out.append((source, node, cost, before if legs else None))
                    for other, w in near.get(node, ()):
                        if other not in done:
                            heapq.heappush(heap, (cost + w, legs + 1, node, other))
            yield pd.DataFrame(out, columns=["source", "node", "cost", "previous"]).astype({"previous": "Int64"})

    kind = sources.schema["node"].dataType.simpleString()
    return sources.select("node").where("node is not null").distinct().mapInPandas(run, f"source {kind}, node {kind}, cost double, previous long")


def distances(edges: DataFrame, sources: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """(source, node, cost, previous): least costs from each source over undirected edges.

    Of routes of equal cost the one of fewer legs is taken, of those the one whose last
    node before is least, so a small graph and a large one give the same rows. A large
    one is relaxed, from the nodes that improved in the round before, until none does; a
    round is one reduction by node, a minimum taken before the exchange, and one join
    with what is known, written once. Edges with a null end or weight, or a negative
    weight, do not exist; unreachable nodes have no row.
    """
    both = stored(symmetric(edges).where("u is not null and v is not null and weight is not null and weight >= 0"))
    if both.count() <= small:
        return _searched(both, sources)
    own = sources.select("node").where("node is not null").distinct()
    nothing = F.lit(None).cast("long")
    state = stored(own.select(F.col("node").alias("source"), "node", F.lit(0).cast("double").alias("cost"), F.lit(0).alias("legs"), nothing.alias("previous"), F.lit(True).alias("fresh")))
    while not state.where("fresh").isEmpty():
        step = F.struct((F.col("cost") + F.col("weight")).alias("cost"), (F.col("legs") + 1).alias("legs"), F.col("u").cast("long").alias("previous"))
        reached = state.where("fresh").join(both, F.col("node") == F.col("u")).select("source", F.col("v").alias("node"), step.alias("c"))
        least = reached.groupBy("source", "node").agg(F.min("c").alias("c"))
        better = F.col("c").isNotNull() & (F.col("cost").isNull() | (F.struct("c.cost", "c.legs") < F.struct("cost", "legs")))
        pick = lambda name: F.when(better, F.col(f"c.{name}")).otherwise(F.col(name)).alias(name)  # noqa: B023,E731
        state = stored(state.drop("fresh").join(least, ["source", "node"], "full").select("source", "node", pick("cost"), pick("legs"), pick("previous"), better.alias("fresh")))
    return state.drop("fresh", "legs")


def components(nodes: DataFrame, links: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """(node, root): the least node that undirected ``links`` (u, v) reach, itself if none.

    Links with a null end do not exist. In a round every node points to its neighbour of
    least rank, a hash of node and round, unless its own is less; links are rewritten to what
    their ends point to, and loops and repeats go. So rounds grow with the logarithm of the
    longest path, each over the links between what is not yet one, which soon are few.
    """
    known = links.where("u is not null and v is not null")
    pairs = stored(known.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    if 2 * pairs.count() <= small:
        own: dict[int, int] = {}

        def root(x: int) -> int:
            while own.setdefault(x, x) != x:
                own[x] = own.setdefault(own[x], own[x])
                x = own[x]
            return x

        for u, v in pairs.collect():
            a, b = root(u), root(v)
            own[max(a, b)] = min(a, b)
        kind = nodes.schema["node"].dataType.simpleString()
        named = nodes.sparkSession.createDataFrame([(x, root(x)) for x in own], f"k {kind}, least {kind}")
        return nodes.select("node").distinct().join(F.broadcast(named), F.col("node") == F.col("k"), "left").select("node", F.coalesce("least", "node").alias("root"))
    label, turn = None, 0
    while not pairs.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("r"), F.col(c).alias("n"))  # noqa: B023,E731
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = stored(both.groupBy("u").agg(F.min(rank("v")).alias("best")).select(F.col("u").alias("k"), F.least("best", rank("u")).getField("n").alias("p")))
        if label is None:
            label = to.select(F.col("k").alias("node"), F.col("p").alias("root"))
        else:
            label = stored(label.join(to, F.col("root") == F.col("k"), "left").select("node", F.coalesce("p", "root").alias("root")))
        moved = pairs.join(to.select(F.col("k").alias("u"), F.col("p").alias("pu")), "u").join(to.select(F.col("k").alias("v"), F.col("p").alias("pv")), "v").where("pu <> pv")
        pairs, turn = stored(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()), turn + 1
    if label is None:
        return nodes.select("node").distinct().withColumn("root", F.col("node"))
    # the least of a group is its root, whichever node the others came to
    named = label.join(label.groupBy("root").agg(F.min("node").alias("least")), "root").select(F.col("node").alias("k"), "least")
    return nodes.select("node").distinct().join(named, F.col("node") == F.col("k"), "left").select("node", F.coalesce("least", "node").alias("root"))


def reach(edges: DataFrame, targets: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """(node, target, cost): the cheapest of all ``targets`` (node) for every node that reaches one.

    One search from all targets at once, so its rows grow with the nodes and not with
    nodes times sources. Of targets at equal cost the least is taken.
    """
    both = stored(symmetric(edges).where("u is not null and v is not null and weight is not null and weight >= 0"))
    own = targets.select("node").where("node is not null").distinct()
    kind = targets.schema["node"].dataType.simpleString()
    if both.count() <= small:
        near: dict[int, list[tuple[int, float]]] = {}
        for u, v, w in both.collect():
            near.setdefault(u, []).append((v, float(w)))
        heap, done = [(0.0, t, t) for (t,) in own.join(both.select(F.col("u").alias("node")), "node", "left_semi").collect()], {}
        heapq.heapify(heap)
        while heap:
            cost, target, node = heapq.heappop(heap)
            if node not in done:
                done[node] = (node, target, cost)
                for other, w in near.get(node, ()):
                    if other not in done:
                        heapq.heappush(heap, (cost + w, target, other))
        found = targets.sparkSession.createDataFrame(list(done.values()), f"node {kind}, target {kind}, cost double")
        alone = own.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("target"), F.lit(0.0).alias("cost"))
        return found.unionByName(alone)
    state = stored(own.select("node", F.struct(F.lit(0).cast("double").alias("cost"), F.col("node").alias("target")).alias("best"), F.lit(True).alias("fresh")))
    while not state.where("fresh").isEmpty():
        step = F.struct((F.col("best.cost") + F.col("weight")).alias("cost"), F.col("best.target").alias("target"))
        least = state.where("fresh").join(both, F.col("node") == F.col("u")).select(F.col("v").alias("node"), step.alias("c")).groupBy("node").agg(F.min("c").alias("c"))
        better = F.col("c").isNotNull() & (F.col("best").isNull() | (F.col("c") < F.col("best")))
        state = stored(state.drop("fresh").join(least, "node", "full").select("node", F.when(better, F.col("c")).otherwise(F.col("best")).alias("best"), better.alias("fresh")))
    return state.select("node", "best.target", "best.cost")


def reachable(nodes: DataFrame, edges: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """(node, n): how many nodes each node reaches, itself included: the size of its component."""
    of = stored(components(nodes, edges.where("weight is not null and weight >= 0"), small))
    return of.join(of.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root").select("node", "n")


def best_target(costs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target, cost): the cheapest of ``targets`` (node), the least on ties."""
    return costs.join(targets.select("node").distinct(), "node", "left_semi").groupBy("source").agg(F.min(F.struct("cost", "node")).alias("b")).select("source", F.col("b.node").alias("target"), "b.cost")


def with_fallback(edges: DataFrame, nodes: DataFrame, exits: DataFrame, last_resort: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """(source, target, cost): the cheapest exit of every node, or exit or last resort where no exit is reached."""
    first = stored(reach(edges, exits, small))
    rest = reach(edges, exits.select("node").union(last_resort.select("node")), small).join(first.select("node"), "node", "left_anti")
    found = first.unionByName(rest).join(nodes.select("node").distinct(), "node", "left_semi")
    return found.select(F.col("node").alias("source"), "target", "cost")


def paths(costs: DataFrame, ends: DataFrame) -> DataFrame:
    """(source, target, path array): routes to ``ends`` (source, target), walked back along ``previous`` to the source."""
    step = costs.select("source", "node", "previous")
    open_ = ends.select("source", "target", F.array(F.col("target").cast("long")).alias("path"), F.col("target").cast("long").alias("at"))
    done = None
    while True:
        walked = stored(open_.join(step.withColumnRenamed("node", "at"), ["source", "at"]))
        over = walked.where("previous is null").select("source", "target", "path")
        done = over if done is None else done.unionByName(over)
        open_ = walked.where("previous is not null").select("source", "target", F.concat(F.array("previous"), F.col("path")).alias("path"), F.col("previous").alias("at"))
        if open_.isEmpty():
            return done


def legs(routes: DataFrame) -> DataFrame:
    """(source, target, leg, u, v) of consecutive nodes along a path."""
    hop = F.expr("transform(sequence(0, size(path) - 2), i -> struct(i as leg, path[i] as u, path[i + 1] as v))")
    return routes.where("size(path) > 1").select("source", "target", F.inline(hop))


def route_costs(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, cost): weights summed along each path; null if an edge is missing."""
    at = legs(routes).join(symmetric(edges), ["u", "v"], "left")
    return at.groupBy("source", "target").agg(F.when(F.count("weight") == F.count(F.lit(1)), F.sum("weight")).alias("cost"))


def fire_weights(edges: DataFrame, fires: DataFrame, radius: float = 5.0, penalty: float = 5000.0) -> DataFrame:
    """Edges (with midpoint x, y) whose weight grows by ``penalty`` for each fire within ``radius``."""
    from ..operators.joins import within

    hits = within(edges.select("u", "v", "x", "y"), fires.select("x", "y"), radius).groupBy(F.col("p_u").alias("u"), F.col("p_v").alias("v")).agg(F.count(F.lit(1)).alias("fires"))
    return edges.join(hits, ["u", "v"], "left").select("u", "v", (F.col("weight") + penalty * F.coalesce("fires", F.lit(0))).alias("weight"))
