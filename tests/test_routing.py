"""Route plans over tables against searches of small graphs one by one."""

import math
import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from evaquery.plans import graph, kernels, routing

EDGE = "u long, v long, weight double"


def made(seed, n=9, share=0.4, weights=(1, 1, 2, 3, 5)):
    rnd = random.Random(seed)
    return [(a, b, float(rnd.choice(weights))) for a in range(n) for b in range(a + 1, n) if rnd.random() < share]


def graph_of(pairs):
    out = {}
    for a, b, w in pairs:
        if w and w > 0 and a is not None and b is not None and a != b:
            for x, y in ((a, b), (b, a)):
                out.setdefault(x, {})[y] = min(w, out.get(x, {}).get(y, math.inf))
    return out


def every(g, start, goal):
    """All loopless routes by (cost, path)."""
    out, stack = [], [(start, [start])]
    while stack:
        at, path = stack.pop()
        if at == goal:
            out.append((kernels.length(g, path), path))
            continue
        stack += [(v, [*path, v]) for v in g.get(at, {}) if v not in path]
    return sorted(out)


def queries(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "q long, start long, goal long")


@pytest.mark.parametrize("seed", range(3))
def test_k_routes_are_the_least_of_all(spark, seed):
    pairs = [*made(seed), (0, None, 1.0), (1, 1, 1.0), (2, 3, None), (4, 5, 0.0), (20, 21, 1.0)]
    g = graph_of(pairs)
    asked = [(0, 8), (8, 0), (3, 3), (0, 20), (2, 7), (99, 1)]
    want = {(i, r): (c, p) for i, (a, b) in enumerate(asked) for r, (c, p) in enumerate(every(g, a, b)[:4], 1)}
    got = routing.k_routes(spark.createDataFrame(pairs, EDGE), queries(spark, asked), 4)
    assert {(r.q, r.rank): (r.cost, r.path) for r in got.collect()} == want
    assert any(r[0] == 0 for r in want)


def test_bans_and_limits(spark):
    pairs = made(5)
    lost = [(0, 4), (1, 2)]
    kept = graph_of([(a, b, w) for a, b, w in pairs if (a, b) not in lost])
    asked = spark.createDataFrame([("x", 0, 8, [(4, 0), (1, 2)], None), ("y", 0, 8, None, 3.0)], "q string, start long, goal long, bans array<struct<a:bigint,b:bigint>>, most double")
    got = routing.k_routes(spark.createDataFrame(pairs, EDGE), asked, 50)
    rows = {q: sorted((r.cost, r.path) for r in got.collect() if r.q == q) for q in "xy"}
    assert rows["x"] == every(kept, 0, 8)[:50]
    assert rows["y"] == [r for r in every(graph_of(pairs), 0, 8) if r[0] <= 3.0][:50]


@pytest.mark.parametrize("seed", [7, 8])
def test_robustness_and_centrality(spark, seed):
    pairs = made(seed, 8, 0.5, (1, 2.5, 3.25, 4.125, 5.0625))
    g, asked = graph_of(pairs), [(a, b) for a, b in permutations(range(0, 8, 2), 2)]
    edges, q = spark.createDataFrame(pairs, EDGE), queries(spark, asked)
    robust = {r.q: (r.cost, r.path, r.robustness) for r in routing.most_robust(edges, q).collect()}
    central = {r.q: (r.level1, r.distinct1, r.level2, r.distinct2) for r in routing.evacuation_centrality(edges, q).collect()}
    for i, (a, b) in enumerate(asked):
        near = [(c, p) for c, p in every(g, a, b)[:3]]
        rated = [(-kernels.robustness(g, p, 0.5), c, p) for c, p in near if c <= 1.5 * near[0][0]]
        assert robust[i] == (min(rated)[1], min(rated)[2], -min(rated)[0])
        assert central[i] == kernels.evacuation_centrality(g, a, b, 0.5)


def test_every_route_and_names(spark):
    pairs = made(3, 7)
    g, asked = graph_of(pairs), [(0, 6), (2, 5), (4, 4)]
    edges, q = spark.createDataFrame(pairs, EDGE), queries(spark, asked)
    got = routing.every_route(edges, q).collect()
    for i, (a, b) in enumerate(asked):
        assert sorted((r.cost, r.path) for r in got if r.q == i) == every(g, a, b)
    for search in routing.ALGORITHMS.values():
        assert {r.q: r.cost for r in search(edges, q).collect()} == {i: every(g, a, b)[0][0] for i, (a, b) in enumerate(asked)}


@pytest.mark.parametrize("seed", range(3))
def test_disjoint_routes(spark, seed):
    pairs = made(20 + seed, 10, (0.2, 0.35, 0.6)[seed])
    g = graph_of(pairs)
    asked = [(a, b) for a in range(0, 10, 3) for b in range(1, 10, 4) if a != b] + [(3, 3), (0, 77)]
    got = {r.q: r.routes for r in routing.disjoint_routes(spark.createDataFrame(pairs, EDGE), queries(spark, asked)).collect()}
    assert got == {i: kernels.edge_disjoint(g, a, b) for i, (a, b) in enumerate(asked) if a != b}


@pytest.mark.parametrize("seed", range(2))
def test_betweenness(spark, seed):
    pairs = made(40 + seed, 12, 0.3)
    g, n = graph_of(pairs), len(graph_of(pairs))
    edges = spark.createDataFrame(pairs, EDGE)
    for sources in (list(range(12)), [1, 5]):
        got = {r.node: r.score for r in routing.betweenness(edges, spark.createDataFrame([(s,) for s in sources], "node long")).collect()}
        want = kernels.betweenness(g, [s for s in sources if s in g], list(g))
        assert got == {k: pytest.approx(x * (n - 1) * (n - 2)) for k, x in want.items()}


def test_landmarks_keep_a_search_narrow(spark):
    rnd = random.Random(1)
    side = 14
    grid = [(x * side + y, x * side + y + step, float(rnd.randint(2, 4))) for x in range(side) for y in range(side) for step, ok in ((1, y < side - 1), (side, x < side - 1)) if ok]
    edges = spark.createDataFrame([*grid, (900, 901, 1.0)], EDGE)
    q = queries(spark, [(0, 30), (100, 101), (5, 5), (0, 900)])
    marks = routing.landmarks(edges, 4)
    assert marks.select("landmark").distinct().count() == 4
    got = {r.q: r for r in routing.point_to_point(edges, q, marks).collect()}
    costs = {(r.source, r.node): r.cost for r in graph.distances(edges, q.select(F.col("start").alias("node"))).collect()}
    assert {i: r.cost for i, r in got.items()} == {i: costs[a, b] for i, (a, b) in enumerate([(0, 30), (100, 101), (5, 5)])}
    assert all(r.touched < 60 for r in got.values())


def test_landmarks_take_one_search_each_and_one_to_begin_with(spark, monkeypatch):
    asked = []
    search = routing.distances
    monkeypatch.setattr(routing, "distances", lambda edges, sources: asked.append([r[0] for r in sources.collect()]) or search(edges, sources))
    line = spark.createDataFrame([(i, i + 1, 1.0) for i in range(8)], "u long, v long, weight double")
    got = {(m, n): c for m, n, c in routing.landmarks(line, 3).select("landmark", "node", "cost").collect()}
    assert asked == [[0], [8], [0], [4]]
    assert got == {(m, n): float(abs(m - n)) for m in (8, 0, 4) for n in range(9)}
