import math
import random
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from evaquery.operators import aggregates, filters, windows
from evaquery.plans import graph, kernels, scores, sim


def random_graph(seed, n=7, p=0.45):
    rnd = random.Random(seed)
    g = {}
    for a in range(n):
        for b in range(a + 1, n):
            if rnd.random() < p:
                w = rnd.randint(1, 9)
                g.setdefault(a, {})[b] = w
                g.setdefault(b, {})[a] = w
    return g


def all_paths(g, s, t):
    inner = [x for x in g if x not in (s, t)]
    out = []
    for k in range(len(inner) + 1):
        for mid in permutations(inner, k):
            p = [s, *mid, t]
            if all(b in g.get(a, {}) for a, b in zip(p, p[1:])):
                out.append((kernels.length(g, p), p))
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
def test_kernels_against_all_paths(seed):
    g = random_graph(seed)
    every = all_paths(g, 0, 6)
    cost, path = kernels.search(g, 0, 6)
    assert (cost == every[0][0] and kernels.length(g, path) == cost) if every else (cost == math.inf and path == [])
    got = kernels.cheapest(g, 0, 6, 4)
    assert [c for c, _ in got] == [c for c, _ in every[:4]]
    if every:
        limit = 1.5 * cost
        lost = lambda e: min((c for c, p in every if e not in {frozenset(x) for x in zip(p, p[1:])}), default=math.inf)
        assert kernels.robustness(g, path, 0.5) == sum(lost(frozenset(e)) <= limit for e in zip(path, path[1:])) <= len(path) - 1
        c, p, r = kernels.most_robust(g, 0, 6, 3, 0.5)
        assert c <= limit and r >= kernels.robustness(g, got[0][1], 0.5)
        n1, d1, n2, d2 = kernels.evacuation_centrality(g, 0, 6, 0.5)
        assert n1 == kernels.robustness(g, path, 0.5) and d1 <= n1 and d2 <= n2


@pytest.mark.parametrize("seed", range(4))
def test_edge_disjoint_routes(seed):
    g = random_graph(seed)
    sides = [{0, *x} for k in range(6) for x in combinations(range(1, 6), k)]
    cut = min(sum(b not in side for a in side for b in g.get(a, {})) for side in sides)
    assert kernels.edge_disjoint(g, 0, 6) == cut


def test_unreachable_and_betweenness():
    g = {0: {1: 1.0}, 1: {0: 1.0, 2: 1.0}, 2: {1: 1.0}, 9: {}}
    assert kernels.search(g, 0, 9) == (math.inf, []) and kernels.evacuation_centrality(g, 0, 9, 0.5) == (0, 0, 0, 0)
    assert kernels.betweenness({k: v for k, v in g.items() if v}, [0, 1, 2], [0, 1, 2])[1] == pytest.approx(1.0)
    assert kernels.search(g, 0, 2, place={0: (0, 0), 1: (1, 0), 2: (2, 0)}) == (2.0, [0, 1, 2])
    assert len(kernels.removals([0, 1, 2, 3], 2)) == 3


@pytest.mark.parametrize("small", [0, 100_000])
def test_plans_against_kernels(spark, small):
    g = random_graph(3, n=12, p=0.25)
    edges = spark.createDataFrame([(a, b, float(w)) for a in g for b, w in g[a].items() if a < b], "u long, v long, weight double")
    nodes = spark.range(12).toDF("node")
    got = {(r.source, r.node): r.cost for r in graph.distances(edges, nodes.where("node < 3"), small=small).collect()}
    want = {(s, t): c for s in range(3) for t in range(12) if (c := kernels.search(g, s, t)[0] if s != t else 0.0) < math.inf}
    assert got == want
    costs = graph.distances(edges, nodes.where("node = 0"), small=small)
    routes = graph.paths(costs, costs.where("node <> 0").select("source", F.col("node").alias("target")))
    assert {r.target: r.cost for r in graph.route_costs(routes, edges).collect()} == {t: c for (s, t), c in want.items() if s == 0 and t != 0}
    comp = {r.node: r.root for r in graph.components(nodes, edges, small=small).collect()}
    assert all(comp[a] == comp[b] for a in g for b in g[a]) and all(comp[n] == min(k for k in comp if comp[k] == comp[n]) for n in comp)


def test_windows_and_masks(spark):
    t = spark.createDataFrame([("a", float(i), float(i) * 0.005, 0.0) for i in range(25)], "k string, t double, x double, y double")
    assert windows.stuck(t, "k", "t").count() == 6
    p = spark.createDataFrame([("a", 1, [1, 2, 3]), ("a", 2, [1, 4, 3])], "k string, t int, path array<int>")
    assert [r.overlap for r in windows.jaccard_with_previous(p, "k", "t", "path").orderBy("t").collect()] == [None, 0.5]
    paths = spark.createDataFrame([(1, [1, 2, 3, 4])], "path_id int, path array<int>")
    c = spark.createDataFrame([(2, 2.0), (3, 8.0)], "node int, c double")
    assert aggregates.geometric_agility(paths, c).first().agility == pytest.approx(4.0)
    assert aggregates.path_scores(paths, c.select("node", (F.col("c") / 10).alias("score"))).first().least == 0.2
    assert filters.layers_of("dual, object") == {"nodes", "edges", "object"} and filters.layers_of("") == set(filters.LAYERS["all"])
    assert len(filters.LAYERS) == 13 and len(filters.PRESETS) == 15 and filters.preset("graph-vertical") == ({"transfer"}, "vertical_connectivity")
    with pytest.raises(ValueError):
        filters.layers_of("nothing")
    times = spark.createDataFrame([(1, float(t)) for t in range(4)], "node int, t double")
    spans = spark.createDataFrame([(1, "hold", 1.0, 1.0, 0.0, None, 0), (1, "odd", 0.0, 9.0, 0.0, None, 1)], "node int, kind string, start double, dur double, v1 double, v2 double, ordinal int")
    assert [r.score for r in scores.at_times(times, spans, alpha=0.5).orderBy("t").collect()] == [1.0, 0.5, 0.25, 0.625]


def test_discrete_run(spark):
    agents = spark.range(6).toDF("agent")
    routes = spark.createDataFrame([(a, leg, leg, leg + 1, 2.4) for a in range(5) for leg in range(2)], "agent long, leg int, u int, v int, length double")
    got = {r.agent: (r.status, r.t) for r in sim.discrete(agents, routes, 20).collect()}
    assert got[5] == ("stuck", 0) and all(got[a][0] == "done" for a in range(5))
    alone = sim.discrete(agents.where("agent = 0"), routes.where("agent = 0"), 20).first()
    assert alone.t == 4 < got[0][1]  # five on one edge are slower than one


def test_continuous_runs(spark):
    walls = spark.createDataFrame([(0.0, 0.0, 10.0, 3.0)], "x0 double, y0 double, x1 double, y1 double")
    crowd = sim.population(spark, 40, 10.0, 8.0, walls)
    rows = crowd.collect()
    assert len(rows) == 40 and all(r.y > 3 for r in rows) and {r.profile for r in rows} <= {"Adult", "Rolling", "Elderly"}
    agents = crowd.crossJoin(spark.range(2).toDF("run")).select("run", "agent", "profile", "x", "y")
    log = sim.continuous(spark.range(2).toDF("run"), agents, [(10.0, 8.0)], [(0.0, 3.0, 10.0, 3.0)], 400).collect()
    out = [r for r in log if r.Evento == "EVACUACION_COMPLETA"]
    assert len(out) >= 70 and len({(r.run, r.AgenteID) for r in out}) == len(out)
    assert {r.Evento for r in log} <= {"CAMBIO_RUTA", "EVACUACION_COMPLETA", "RECALCULO"}
    legs = spark.createDataFrame([("a", 0, 0.0, 0.0, 10.0, 0.0)], "agent string, leg int, ax double, ay double, bx double, by double")
    walk = sim.walked(legs).select("agent", F.col("frame").alias("t"), "x", "y")
    assert walk.count() == 25
    assert sim.evacuated(walk, spark.createDataFrame([(9.0, 0.0)], "x double, y double")).first().t == 18
