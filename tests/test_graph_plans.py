"""Plans over edge tables: the search in tasks and the relaxation over tables give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from evaquery.operators import joins, windows
from evaquery.plans import graph, kernels, sim

EDGE = "u long, v long, weight double"


def frames(spark, pairs, n):
    return spark.createDataFrame(pairs, EDGE), spark.range(n).toDF("node")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def tied(seed):
    """Small weights, zero among them, so that many routes cost the same; null ends and weights."""
    rnd = random.Random(seed)
    pairs = [(a, b, float(rnd.choice([0, 1, 1, 2]))) for a in range(14) for b in range(a + 1, 14) if rnd.random() < 0.25]
    return pairs + [(1, None, 1.0), (None, 2, 1.0), (3, 4, None), (5, 6, -1.0), (7, 7, 1.0)]


@pytest.mark.parametrize("seed", range(3))
def test_both_ways_agree_on_ties_and_nulls(spark, seed):
    edges, nodes = frames(spark, tied(seed), 16)
    for plan in (lambda k: graph.distances(edges, nodes, small=k), lambda k: graph.components(nodes, edges, small=k), lambda k: graph.reach(edges, nodes.where("node % 5 = 0"), small=k), lambda k: graph.reachable(nodes, edges, small=k)):
        assert rows(plan(0)) == rows(plan(100_000))
    costs = graph.distances(edges, nodes.where("node < 2"), small=0)
    best = {(r.source, r.node): (r.cost, r.previous) for r in costs.collect()}
    near = {}
    for a, b, w in tied(seed):
        if a is not None and b is not None and w is not None and w >= 0:
            near.setdefault(a, []).append((b, w))
            near.setdefault(b, []).append((a, w))
    for (s, t), (cost, previous) in best.items():
        if t != s:
            assert any(b == previous and best[s, b][0] + w == cost for b, w in near[t])
            assert cost == min(best[s, b][0] + w for b, w in near[t] if (s, b) in best)


def test_long_lines_have_no_cap(spark):
    n = 40
    edges, nodes = frames(spark, [(i, i + 1, 1.0) for i in range(n)], n + 1)
    for small in (0, 100_000):
        costs = graph.distances(edges, nodes.where("node = 0"), small=small)
        assert {r.node: r.cost for r in costs.collect()} == {i: float(i) for i in range(n + 1)}
    ends = costs.where("node <> source").select("source", F.col("node").alias("target"))
    assert {r.target: len(r.path) for r in graph.paths(costs, ends).collect()} == {i: i + 1 for i in range(1, n + 1)}
    far, all_ = frames(spark, [(i, i + 1, 1.0) for i in range(1000)], 1001)
    assert graph.distances(far, all_.where("node = 0")).agg(F.max("cost")).first()[0] == 1000.0
    for small in (0, 100_000):
        assert graph.components(all_, far, small=small).select("root").distinct().count() == 1


def test_reach_is_the_best_of_all_targets(spark):
    rnd = random.Random(4)
    edges, nodes = frames(spark, [(a, b, float(rnd.randint(1, 4))) for a in range(20) for b in range(a) if rnd.random() < 0.12] + [(30, 31, 1.0)], 34)
    targets = nodes.where("node in (0, 7, 19, 33)")
    costs = graph.distances(edges, nodes)
    want = {r.source: (r.target, r.cost) for r in graph.best_target(costs, targets).collect()}
    for small in (0, 100_000):
        assert {r.node: (r.target, r.cost) for r in graph.reach(edges, targets, small).collect()} == want | {n: (n, 0.0) for n in (0, 7, 19, 33)}
    got = graph.with_fallback(edges, nodes, nodes.where("node = 0"), nodes.where("node = 31"))
    assert {r.source: r.target for r in got.where("source >= 30").collect()} == {30: 31, 31: 31}


def test_kernels_of_small_and_large_graphs(spark, monkeypatch):
    edges = spark.createDataFrame([("a", 1, 2, 1.0), ("a", 2, 3, 1.0), ("a", 1, 3, 3.0), ("b", 1, 2, 5.0)], "grp string, u long, v long, weight double")
    asked = spark.createDataFrame([("a", 1, 3), ("a", 3, 1), ("b", 1, 2), ("b", 1, 9)], "grp string, start long, goal long")
    want = [rows(kernels.routes(edges, asked, "grp")), rows(kernels.resilience(edges, asked, "grp"))]
    assert len(want[0]) == 4
    monkeypatch.setattr(kernels, "SMALL_GRAPH", 0)
    assert [rows(kernels.routes(edges, asked, "grp")), rows(kernels.resilience(edges, asked, "grp"))] == want


def test_everybody_finds_a_place(spark):
    walls = spark.createDataFrame([(0.0, 0.0, 10.0, 7.2)], "x0 double, y0 double, x1 double, y1 double")
    crowd = sim.population(spark, 1000, 10.0, 8.0, walls).collect()
    assert len({r.agent for r in crowd}) == len(crowd) == 1000 and all(r.y > 7.2 for r in crowd)
    assert sim.population(spark, 0, 10.0, 8.0, walls).count() == 0
    two = spark.createDataFrame([(0.0, 0.0, 10.0, 5.0), (-1.0, 4.0, 6.0, 9.0), (6.0, 5.0, 11.0, 8.0)], walls.schema)
    with pytest.raises(ValueError):
        sim.population(spark, 5, 10.0, 8.0, two)


def test_nearest_by_rings(spark):
    rnd = random.Random(2)
    pts = [(i, rnd.uniform(-50, 50), rnd.choice([rnd.uniform(-50, 50), 1000.0])) for i in range(60)] + [(90, None, 1.0), (91, 0.0, float("nan"))]
    tgt = [(i, float(rnd.randint(-5, 5)), float(rnd.randint(-5, 5))) for i in range(30)] + [(77, None, 0.0)]
    p, t = spark.createDataFrame(pts, "k long, x double, y double"), spark.createDataFrame(tgt, "n long, x double, y double")
    want = [(k, *min(((x - a) ** 2 + (y - b) ** 2, n) for n, a, b in tgt[:30])[::-1]) for k, x, y in pts[:60]]
    assert [(a, b, pytest.approx(c)) for a, b, c in sorted(want, key=str)] == rows(joins.nearest(p, t, "k", "n"))
    assert joins.nearest(p, t.limit(0), "k", "n").count() == 0 == joins.nearest(p.limit(0), t, "k", "n").count()
    one = joins.nearest(p, t.where("n = 3"), "k", "n")
    assert one.count() == 60


def test_intervals_in_stretches(spark):
    rnd = random.Random(3)
    spans = [(rnd.randrange(3), rnd.uniform(-20, 20), rnd.choice([0.0, 1.0, 30.0, -1.0, None])) for _ in range(50)]
    times = [(rnd.randrange(3), float(rnd.randint(-25, 40))) for _ in range(60)] + [(0, None)]
    s, t = spark.createDataFrame(spans, "k int, start double, dur double"), spark.createDataFrame(times, "k int, t double")
    want = sorted(((k, x, a) for k, x in times if x is not None for j, a, d in spans if j == k and d is not None and d >= 0 and a <= x <= a + d), key=str)
    for bucket in (None, 0.7, 100.0):
        assert rows(joins.in_interval(t, s, "k", bucket).select("k", "t", "start")) == want
    assert joins.in_interval(t, s.limit(0), "k").count() == 0


def test_moving_averages(spark):
    rnd = random.Random(6)
    data = [(k, float(i), rnd.random()) for k in ("a", "b", None) for i in range(300)]
    df = spark.createDataFrame(data, "k string, t double, v double").repartition(7)
    end, own = {}, {}
    for k, t, v in data:
        end[k] = end.get(k, 1.0) * 0.7 + v * 0.3
        own[k, t] = own[k, t - 1] * 0.7 + v * 0.3 if t else v
    assert {r.k: r.ema for r in windows.ema(df, "k", "t", "v").collect()} == {k: pytest.approx(x, abs=1e-6) for k, x in end.items()}
    assert {(r.k, r.t): r.v for r in windows.smoothed(df, "k", "t", "v", 0.3).collect()} == {k: pytest.approx(x) for k, x in own.items()}


def test_one_key_is_averaged_in_ranges(spark):
    rnd = random.Random(8)
    data = [("a", float(i), rnd.random()) for i in range(3000)] + [("b", 0.0, 1.0), (None, 1.0, 0.5), (None, 2.0, 0.0)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(data, "k string, t double, v double").repartition(5)
        parts = windows._averaged(df, "k", ["t"], "v", 0.2).groupBy("part").count().collect()
        got = {(r.k, r.t): r.v for r in windows.smoothed(df, "k", "t", "v", 0.2).collect()}
        end = {r.k: (r.ema, r.n) for r in windows.ema(df, "k", "t", "v", 0.2).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 2 and max(r["count"] for r in parts) < 2500
    mean, one, at = {}, {}, {}
    for k, t, v in data:
        mean[k] = mean[k] * 0.8 + v * 0.2 if k in mean else v
        one[k] = one.get(k, 1.0) * 0.8 + v * 0.2
        at[k, t] = mean[k]
    assert got == {x: pytest.approx(y) for x, y in at.items()}
    assert end == {k: (pytest.approx(one[k], abs=1e-6), n) for k, n in (("a", 3000), ("b", 1), (None, 2))}


def test_components_go_on_with_the_links_that_are_left(spark, monkeypatch):
    """After a round only links between what is not yet one are rows, and each once; labels that fall need all links in every round."""
    edges, nodes = frames(spark, [(a, b, 1.0) for g in range(40) for a in range(g * 8, g * 8 + 8) for b in range(g * 8, a)], 325)
    seen = []
    keep = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: seen.append(keep(df)) or seen[-1])
    found = {r.node: r.root for r in graph.components(nodes, edges, small=0).collect()}
    assert found == {n: n // 8 * 8 if n < 320 else n for n in range(325)}
    sizes = [df.count() for df in seen if df.columns == ["u", "v"]]
    assert sizes[0] == 40 * 28 and all(b < a / 2 for a, b in zip(sizes, sizes[1:]) if a) and sizes[-1] == 0
