"""Slabs against unit squares and clipping, half-edges against the walk round faces."""

import random

import pytest

from evaquery.functions import polygon as P
from evaquery.operators import halfedges, joins, slabs

POLY = "grp int, side string, poly int, rings array<array<array<double>>>"


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]]))) / 2


def shape(rnd):
    """A union of boxes as unit squares, and its rings: borders of the squares, one a ring of its own."""
    cells = set()
    for _ in range(rnd.randint(1, 3)):
        x, y, w, h = rnd.randint(0, 9), rnd.randint(0, 9), rnd.randint(1, 5), rnd.randint(1, 5)
        cells ^= {(i, j) for i in range(x, x + w) for j in range(y, y + h)}
    return cells


def boxes(cells):
    """Even-odd rings of a set of unit squares: a row of them a ring."""
    return [[[float(x), float(y)], [x + 1.0, float(y)], [x + 1.0, y + 1.0], [float(x), y + 1.0], [float(x), float(y)]] for x, y in sorted(cells)]


@pytest.mark.parametrize("width", [3.0, 100.0])
def test_areas_by_unit_squares(spark, width):
    rnd = random.Random(1)
    rows, want = [], {}
    for g in range(30):
        sides = {s: [shape(rnd) for _ in range(rnd.randint(1, 2))] for s in "ab"}
        rows += [(g, s, i, boxes(c)) for s in "ab" for i, c in enumerate(sides[s])]
        a, b = (set().union(*sides[s]) for s in "ab")
        if a | b:
            want[g] = tuple(map(float, (len(a), len(b), len(a & b), len(a | b), len(a - b), len(b - a))))
    df = spark.createDataFrame(rows, POLY)
    assert {r.grp: tuple(r)[1:] for r in slabs.overlay_areas(df, width).collect()} == want
    for k, op in ((2, "both"), (3, "either"), (4, "a_only"), (5, "b_only")):
        parts = {}
        for r in slabs.overlay_parts(df, op, width).collect():
            parts[r.grp] = parts.get(r.grp, 0) + area(r.ring)
        assert {g: pytest.approx(v[k]) for g, v in want.items() if v[k]} == parts
    assert "Python" not in slabs.overlay_areas(df, width)._jdf.queryExecution().toString().replace("PythonSQL", "")


def clipped(a, b):
    """Convex ``a`` inside convex ``b``, both counter-clockwise."""
    for p, q in zip(b, [*b[1:], b[0]]):
        inside = lambda z: (q[0] - p[0]) * (z[1] - p[1]) - (q[1] - p[1]) * (z[0] - p[0])  # noqa: B023,E731
        out = []
        for s, e in zip(a, [*a[1:], a[0]]):
            u, v = inside(s), inside(e)
            if u >= 0:
                out.append(s)
            if u * v < 0:
                out.append((s[0] + (e[0] - s[0]) * u / (u - v), s[1] + (e[1] - s[1]) * u / (u - v)))
        a = out
        if not a:
            return []
    return a


def test_slanted_edges_by_clipping(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for g in range(40):
        a, b = ([(round(rnd.uniform(-5, 5), 3), round(rnd.uniform(-5, 5), 3)) for _ in range(3)] for _ in "ab")
        a, b = (t if (t[1][0] - t[0][0]) * (t[2][1] - t[0][1]) - (t[1][1] - t[0][1]) * (t[2][0] - t[0][0]) > 0 else t[::-1] for t in (a, b))
        rows += [(g, s, i, [[list(p) for p in t]]) for i, (s, t) in enumerate((("a", a), ("b", b)))]
        want[g] = area(clipped(a, b)) if clipped(a, b) else 0.0
    got = {r.grp: r for r in slabs.overlay_areas(spark.createDataFrame(rows, POLY), 2.5).collect()}
    for g, both in want.items():
        assert got[g].both == pytest.approx(both, abs=1e-5)
        assert got[g].area_a == pytest.approx(area(rows[2 * g][3][0]), abs=1e-5) and got[g].a_only + got[g].both == pytest.approx(got[g].area_a, abs=1e-5)


def test_no_area(spark):
    odd = [(1, "a", 1, []), (2, "a", 1, None), (3, "a", 1, [[[0.0, 0.0], [1.0, 1.0]]]), (4, "b", 1, [[[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]]])]
    assert slabs.overlay_areas(spark.createDataFrame(odd, POLY), 4.0).count() == 0


LINE = "grp int, ax double, ay double, bx double, by double"


def faces(spark, lines, size=7.0, most=None):
    made, loose = halfedges.faces(spark.createDataFrame([(0, *a, *b) for a, b in lines], LINE), size, most=most)
    return sorted((r.area, r.x, r.y) for r in made.collect()), sum(r.loose for r in loose.collect())


def walked(lines):
    """The faces of the walk by angles, one graph in memory; faces inside others stay whole."""
    rings, loose = P.faces(lines)
    return sorted((P.area(r), P.centroid(r)) for r in rings), loose


@pytest.mark.parametrize("seed", range(4))
def test_faces_are_those_of_the_walk(spark, seed):
    rnd = random.Random(seed)
    n = 12
    lines = [((float(x), float(y)), (x + 4.0, float(y))) for x in range(0, n, 4) for y in range(0, n + 1, 4) if rnd.random() < 0.9] + [((float(x), float(y)), (float(x), y + 4.0)) for x in range(0, n + 1, 4) for y in range(0, n, 4) if rnd.random() < 0.9]
    lines += [((float(rnd.randint(0, n)), 0.0), (float(rnd.randint(0, n)), float(n))) for _ in range(seed)]
    got, loose = faces(spark, lines)
    want, loose_ = walked(lines)
    assert [g[0] for g in got] == [pytest.approx(a, abs=1e-4) for a, _ in want] and loose == loose_
    assert sorted(g[1:] for g in got) == [(pytest.approx(x, abs=1e-4), pytest.approx(y, abs=1e-4)) for x, y in sorted(c for _, c in want)]


def test_lines_on_each_other_and_chains(spark):
    square = [((0.0, 0.0), (4.0, 0.0)), ((2.0, 0.0), (6.0, 0.0)), ((4.0, 0.0), (4.0, 4.0)), ((4.0, 4.0), (0.0, 4.0)), ((0.0, 4.0), (0.0, 0.0)), ((0.0, 0.0), (0.0, 4.0))]
    chain = [((4.0 + i, 4.0), (5.0 + i, 4.0)) for i in range(5)]
    got, loose = faces(spark, square + chain + [((1.0, 1.0), (1.0, 1.0))])
    assert got == [(16.0, 2.0, 2.0)] and loose == 6
    assert faces(spark, chain) == ([], 5)
    made, loose = halfedges.faces(spark.createDataFrame([], LINE), 4.0)
    assert made.count() == 0 == loose.count()


def test_dense_tiles_are_cut(spark):
    rnd = random.Random(4)
    rows = [(i, 0, x := rnd.uniform(0, 1), y := rnd.uniform(0, 1), x + 0.02, y + 0.02) for i in range(300)] + [(1000 + i, i % 2, 10.0 * i, 0.0, 10.0 * i + rnd.choice([5, 25]), 9.0) for i in range(60)] + [(2000 + i, 0, 0.5, 0.5, 0.51, 0.51) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, level int, x0 double, y0 double, x1 double, y1 double")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5])
    for most in (8, 40, 100_000):
        assert sorted((r.a_id, r.b_id) for r in joins.box_pairs(df, "id", ["level"], 16, most).collect()) == want
    cut = joins.tree_tiles(df.where("id < 2000"), ["level"], 16, 40)
    assert max(r["count"] for r in cut.groupBy("level", "depth", "tx", "ty").count().collect()) <= 40


def test_full_cells_are_dealt(spark):
    rnd = random.Random(5)
    pts = [(i, rnd.choice([1.0, rnd.uniform(0, 20)]), rnd.choice([1.0, rnd.uniform(0, 20)])) for i in range(200)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    pairs = lambda most: sorted((r.p_id, r.t_id, r.d) for r in joins.within(df, df.where("id % 3 = 0"), 2.0, most).collect())
    assert pairs(5) == pairs(10_000) and len(pairs(5)) == sum((x - a) ** 2 + (y - b) ** 2 <= 4 for _, x, y in pts for i, a, b in pts if i % 3 == 0)


def test_closed_faces_leave_the_rounds(spark, monkeypatch):
    """A grid of 8 by 8 squares: the last round has the half-edges around the whole only."""
    kept = halfedges.stored
    rows = []

    def counted(df):
        made = kept(df)
        rows.append(made.count())
        return made

    monkeypatch.setattr(halfedges, "stored", counted)
    n = 8
    lines = [((x, y), (x + 1, y)) for x in range(n) for y in range(n + 1)] + [((x, y), (x, y + 1)) for x in range(n + 1) for y in range(n)]
    pieces = spark.createDataFrame([(0, tuple(map(float, a)), tuple(map(float, b))) for a, b in lines], "grp int, a struct<x:double,y:double>, b struct<x:double,y:double>")
    sizes = sorted(r[0] for r in halfedges.labelled(halfedges.half_edges(pieces)).groupBy("face").count().select("count").collect())
    assert sizes == [4] * n * n + [4 * n]
    assert rows[0] == 2 * len(lines) and rows[-1] == 4 * n
