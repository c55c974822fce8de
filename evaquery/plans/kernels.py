"""Route kernels for one small graph at a time, run in many tasks: a task takes the
graph of one group (profile, time, exit) from ``applyInPandas``."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from .graph import SMALL_GRAPH

Graph = dict[int, dict[int, float]]
Place = dict[int, tuple[float, float]]


def graph_of(rows: pd.DataFrame) -> Graph:
    """Undirected adjacency of (u, v, weight) rows; of parallel edges the cheapest."""
    out: Graph = {}
    for u, v, w in zip(rows["u"], rows["v"], rows["weight"]):
        if w is not None and w == w and w > 0:
            for a, b in ((u, v), (v, u)):
                out.setdefault(a, {})[b] = min(w, out.get(a, {}).get(b, math.inf))
    return out


def search(graph: Graph, start: int, goal: int, place: Place | None = None, banned_nodes: frozenset = frozenset(), banned_edges: frozenset = frozenset()) -> tuple[float, list[int]]:
    """(cost, path) of the cheapest route, by A* where places are known (straight-line bound) and
    by Dijkstra otherwise; (inf, []) if there is none. Ties take the least node."""
    here = place or {}

    def bound(n: int) -> float:
        return math.dist(here[n], here[goal]) if n in here and goal in here else 0.0

    if start in banned_nodes or goal in banned_nodes or (start != goal and (start not in graph or goal not in graph)):
        return math.inf, []
    heap, best, back = [(bound(start), 0.0, start, None)], {}, {}
    while heap:
        _, cost, node, before = heapq.heappop(heap)
        if node in best:
            continue
        best[node], back[node] = cost, before
        if node == goal:
            path = [node]
            while (node := back[node]) is not None:
                path.append(node)
            return cost, path[::-1]
        for other, w in graph.get(node, {}).items():
            if other not in best and other not in banned_nodes and frozenset((node, other)) not in banned_edges:
                heapq.heappush(heap, (cost + w + bound(other), cost + w, other, node))
    return math.inf, []


def cheapest(graph: Graph, start: int, goal: int, k: int, place: Place | None = None) -> list[tuple[float, list[int]]]:
    """The ``k`` cheapest loopless routes, deviating from each found one at every node."""
    first = search(graph, start, goal, place)
    if not first[1]:
        return []
    found, waiting, seen = [first], [], {tuple(first[1])}
    while len(found) < k:
        last = found[-1][1]
        for i in range(len(last) - 1):
            root = last[: i + 1]
            cut = frozenset(frozenset(p[i : i + 2]) for _, p in found if p[: i + 1] == root and len(p) > i + 1)
            _, spur = search(graph, last[i], goal, place, frozenset(root[:-1]), cut)
            if spur and tuple(whole := root[:-1] + spur) not in seen:
                seen.add(tuple(whole))
                heapq.heappush(waiting, (length(graph, whole), whole))
        if not waiting:
            break
        found.append(heapq.heappop(waiting))
    return found


def length(graph: Graph, path: list[int]) -> float:
    return sum(graph[a][b] for a, b in zip(path, path[1:]))


#: Route algorithms by name; each takes (graph, start, goal, places).
ALGORITHMS: dict[str, Callable] = {
    "dijkstra": lambda g, a, b, place: search(g, a, b),
    "astar": lambda g, a, b, place: search(g, a, b, place),
    "yen_ksp": lambda g, a, b, place: (cheapest(g, a, b, 3, place) or [(math.inf, [])])[0],
}


def robustness(graph: Graph, path: list[int], tolerance: float) -> int:
    """How many of a route's edges can each be lost at no more than (1 + tolerance) times its cost."""
    limit = (1 + tolerance) * length(graph, path)
    lost = (frozenset((a, b)) for a, b in zip(path, path[1:]))
    return sum(search(graph, path[0], path[-1], banned_edges=frozenset([e]))[0] <= limit for e in lost)


def most_robust(graph: Graph, start: int, goal: int, k: int, tolerance: float) -> tuple[float, list[int], int]:
    """(cost, path, robustness) of the most robust of the ``k`` cheapest routes within tolerance, the cheaper on ties."""
    routes = cheapest(graph, start, goal, k)
    if not routes:
        return math.inf, [], 0
    rated = [(-robustness(graph, p, tolerance), c, p) for c, p in routes if c <= (1 + tolerance) * routes[0][0]]
    r, c, p = min(rated)
    return c, p, -r


def removals(path: list[int], k: int) -> list[frozenset]:
    """All sets of ``k`` edges of a route."""
    return [frozenset(x) for x in combinations([frozenset(e) for e in zip(path, path[1:])], k)]


def evacuation_centrality(graph: Graph, start: int, goal: int, tolerance: float) -> tuple[int, int, int, int]:
    """(level 1, distinct, level 2, distinct): alternative routes after the loss of one edge of the
    main route, and of one more edge of each alternative, that cost at most (1 + tolerance) times it."""
    cost, main = search(graph, start, goal)
    if len(main) < 2:
        return 0, 0, 0, 0
    one, two = [], []
    for lost in removals(main, 1):
        c, path = search(graph, start, goal, banned_edges=lost)
        if path and c <= (1 + tolerance) * cost:
            one.append(tuple(path))
            for more in removals(path, 1):
                c2, path2 = search(graph, start, goal, banned_edges=lost | more)
                if path2 and c2 <= (1 + tolerance) * cost:
                    two.append(tuple(path2))
    return len(one), len(set(one)), len(two), len(set(two))


def edge_disjoint(graph: Graph, start: int, goal: int) -> int:
    """How many routes share no edge: augmenting paths over edges of capacity one."""
    spare = {(a, b): 1 for a in graph for b in graph[a]}
    n = 0
    while start != goal:
        back, queue = {start: start}, [start]
        while queue and goal not in back:
            node = queue.pop(0)
            for other in sorted(graph.get(node, {})):
                if other not in back and spare[node, other] > 0:
                    back[other] = node
                    queue.append(other)
        if goal not in back:
            break
        at = goal
        while at != start:
            spare[back[at], at] -= 1
            spare[at, back[at]] += 1
            at = back[at]
        n += 1
    return n


def betweenness(graph: Graph, sources: list[int], targets: list[int]) -> dict[int, float]:
    """Share of cheapest routes from sources to targets that pass through each node, over n (n - 1)."""
    score = dict.fromkeys(graph, 0.0)
    for s in sources:
        dist, ways, before, order, heap = {}, {s: 1.0}, {s: []}, [], [(0.0, s)]
        tentative = {s: 0.0}
        while heap:
            d, v = heapq.heappop(heap)
            if v in dist:
                continue
            dist[v] = d
            order.append(v)
            for w, c in graph.get(v, {}).items():
                new = d + c
                if w not in dist and (w not in tentative or new < tentative[w]):
                    tentative[w], ways[w], before[w] = new, ways[v], [v]
                    heapq.heappush(heap, (new, w))
                elif w not in dist and new == tentative[w]:
                    ways[w] += ways[v]
                    before[w].append(v)
        depends = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            own = depends[w] + (1.0 if w in targets and w != s else 0.0)
            for v in before[w]:
                depends[v] += own * ways[v] / ways[w]
            if w != s:
                score[w] += depends[w]
    n = len(graph)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else x for v, x in score.items()}


def _own(queries: DataFrame, group: str) -> DataFrame:
    """Queries under column ids of their own, for they may stem from the frame that the edges do."""
    return queries.select(F.col(group).alias("asked_group"), F.col("start").alias("start"), F.col("goal").alias("goal"))


def _dealt(edges: DataFrame, queries: DataFrame, group: str, rows: Callable[[object, Graph, list, list], list[tuple]], schema: str) -> DataFrame:
    """``rows`` of every group's graph and its queries.

    If all graphs together are small, counted first, they go to every task and the queries are
    dealt over the tasks; else the edges of a group meet its queries in a task.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    graphs = stored(edges.select(group, "u", "v", "weight"))
    if graphs.count() <= SMALL_GRAPH:
        held = {k: graph_of(own) for k, own in graphs.toPandas().groupby(group)}

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for asked in batches:
                out = [r for k, a, b in zip(asked["asked_group"], asked["start"], asked["goal"]) if k in held for r in rows(k, held[k], [a], [b])]
                yield pd.DataFrame(out, columns=names)

        own = _own(queries, group)
        return own.repartition(own.sparkSession.sparkContext.defaultParallelism, "asked_group", "start", "goal").mapInPandas(run, schema)

    def one(key: tuple, graph_rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(rows(key[0], graph_of(graph_rows), asked["start"].tolist(), asked["goal"].tolist()), columns=names)

    return graphs.groupBy(group).cogroup(_own(queries, group).groupBy("asked_group")).applyInPandas(one, schema)


def routes(edges: DataFrame, queries: DataFrame, group: str, algorithm: str = "dijkstra") -> DataFrame:
    """(group, start, goal, cost, path) for ``queries`` (group, start, goal) on the graph of each group; null cost if there is no way."""

    def rows(key: object, graph: Graph, starts: list, goals: list) -> list[tuple]:
        got = [(a, b, *ALGORITHMS[algorithm](graph, a, b, None)) for a, b in zip(starts, goals)]
        return [(key, a, b, None if c == math.inf else c, p) for a, b, c, p in got]

    kind = edges.schema[group].dataType.simpleString()
    return _dealt(edges, queries, group, rows, f"{group} {kind}, start long, goal long, cost double, path array<long>")


def resilience(edges: DataFrame, queries: DataFrame, group: str, tolerance: float = 0.5, k: int = 3) -> DataFrame:
    """Robust route and evacuation centrality for ``queries`` (group, start, goal)."""

    def rows(key: object, graph: Graph, starts: list, goals: list) -> list[tuple]:
        out = []
        for a, b in zip(starts, goals):
            c, path, r = most_robust(graph, a, b, k, tolerance)
            out.append((key, a, b, None if c == math.inf else c, path, r, *evacuation_centrality(graph, a, b, tolerance)))
        return out

    kind = edges.schema[group].dataType.simpleString()
    return _dealt(edges, queries, group, rows, f"{group} {kind}, start long, goal long, cost double, path array<long>, robustness int, level1 int, distinct1 int, level2 int, distinct2 int")
