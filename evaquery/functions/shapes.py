"""Polygon kernels as columns: Arrow-batched functions over rings, arrays of [x, y] points, open or closed.

A null ring, or one that encloses nothing, gives null, or no parts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import polygon as P

RING = "array<array<double>>"
RINGS = f"array<{RING}>"


def _points(ring) -> list[P.Point]:
    return [(float(p[0]), float(p[1])) for p in ring]


def _sound(ring) -> P.Ring | None:
    return None if ring is None else P.cleaned(_points(ring))


def _parts(rings) -> list[list[P.Ring]]:
    return [P.convex_parts(c) for r in ([] if rings is None else rings) if (c := _sound(r))]


def _listed(rings: list[P.Ring]) -> list:
    return [[list(p) for p in r] for r in rings]


def _same(value) -> object:
    """A key that only values of the same bits share: arrays by their bytes, nested ones and the lists that another
    function of the same task has made element by element."""
    if isinstance(value, np.ndarray) and value.dtype != object:
        return value.tobytes()
    if isinstance(value, (np.ndarray, list, tuple)):
        return tuple(map(_same, value))
    return value.hex() if isinstance(value, float) else value


def _once(f: Callable, *columns: pd.Series) -> pd.Series:
    """``f`` of each row's values, worked out once for rows of a batch that are the same."""
    made: dict = {}
    out = []
    for row in zip(*columns):
        key = tuple(map(_same, row))
        if key not in made:
            made[key] = f(*row)
        out.append(made[key])
    return pd.Series(out, dtype=object)


def _mapped(f: Callable, schema: str, *columns: Column) -> Column:
    """``f`` of each row's values, in Arrow batches; shapes that a batch repeats are worked out once."""

    def one(a: pd.Series) -> pd.Series:
        return _once(f, a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return _once(f, a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _once(f, a, b, c)

    return F.pandas_udf((one, two, three)[len(columns) - 1], schema)(*columns)


def clean(ring: Column) -> Column:
    """The open counter-clockwise ring without repeated or straight points."""
    return _mapped(lambda r: None if (c := _sound(r)) is None else [list(p) for p in c], RING, ring)


def area(ring: Column) -> Column:
    return _mapped(lambda r: None if (c := _sound(r)) is None else abs(P.area(c)), "double", ring)


def convex(ring: Column) -> Column:
    """Whether a ring is convex: nothing lies between it and its hull."""
    return _mapped(lambda r: None if (c := _sound(r)) is None else P.is_convex(c), "boolean", ring)


def node_point(ring: Column) -> Column:
    """[x, y]: the centroid if it is inside or on the border, else a point that is."""
    return _mapped(lambda r: None if (c := _sound(r)) is None else list(P.inner_point(c)), "array<double>", ring)


def union_area(rings: Column) -> Column:
    """Area that any of the rings covers."""
    return _mapped(lambda rs: P.total(P.union(_parts(rs))), "double", rings)


def difference(ring: Column, rings: Column) -> Column:
    """Convex parts of a ring that none of ``rings`` covers, as few as joining them greedily gives."""

    def cut(r, rs) -> list:
        own = _sound(r)
        return [] if own is None else _listed(P.merged(P.difference(P.convex_parts(own), [x for part in _parts(rs) for x in part])))

    return _mapped(cut, RINGS, ring, rings)


def intersection_area(a: Column, b: Column) -> Column:
    return _mapped(lambda x, y: P.total(P.intersection(P.convex_parts(p), P.convex_parts(q))) if (p := _sound(x)) and (q := _sound(y)) else 0.0, "double", a, b)


def symmetric_difference_area(a: Column, b: Column) -> Column:
    return _mapped(lambda x, y: P.symmetric_difference_area(P.convex_parts(p), P.convex_parts(q)) if (p := _sound(x)) and (q := _sound(y)) else None, "double", a, b)


def triangulated(ring: Column) -> Column:
    return _mapped(lambda r: [] if (c := _sound(r)) is None else _listed(P.triangles(c)), RINGS, ring)


def decomposed(ring: Column) -> Column:
    """Convex parts of a ring."""
    return _mapped(lambda r: [] if (c := _sound(r)) is None else _listed(P.decomposed(c)[0]), RINGS, ring)


def inner_borders(ring: Column) -> Column:
    """[ax, ay, bx, by] of every border between two convex parts of a ring."""
    return _mapped(lambda r: [] if (c := _sound(r)) is None else [[*a, *b] for _, _, a, b in P.decomposed(c)[1]], RING, ring)


def contact(a: Column, b: Column) -> Column:
    """[ax, ay, bx, by]: the longest straight border that two rings share; null for none."""
    return _mapped(lambda x, y: [*line[0], *line[1]] if (p := _sound(x)) and (q := _sound(y)) and (line := P.contact(p, q)) else None, "array<double>", a, b)


def way_inside(ring: Column, a: Column, b: Column) -> Column:
    """Length of the shortest way between two points inside a ring."""
    return _mapped(lambda r, p, q: None if (c := _sound(r)) is None else P.inner_distance(c, tuple(p), tuple(q)), "double", ring, a, b)


def faces(lines: Column) -> Column:
    """Rings of the bounded faces of line work, lines as [ax, ay, bx, by], largest first."""
    made = lambda ls: sorted(P.faces([((x[0], x[1]), (x[2], x[3])) for x in ls])[0], key=lambda r: -abs(P.area(r)))
    return _mapped(lambda ls: _listed(made(ls)), RINGS, lines)


def junctions(lines: Column) -> Column:
    """x, y and kind (L, T or X) of every point where wall lines meet, as text, in order."""
    kinds = lambda ls: sorted(f"{round(p[0], 3)} {round(p[1], 3)} {k}" for p, _, _, k, _ in P.junctions([((x[0], x[1]), (x[2], x[3])) for x in ls]))
    return _mapped(kinds, "array<string>", lines)


def cluster_sizes(points: Column) -> Column:
    """How many points each cluster has, in the order the clusters were begun."""
    return _mapped(lambda ps: [len(m) for _, m in P.clustered(_points(ps))], "array<int>", points)


def tile_area(tiles: Column, size: float) -> Column:
    """Area of a chain of square tiles; null for one that is not contiguous and unique."""

    def one(ts) -> float | None:
        try:
            return P.total(P.tile_footprint([(int(t[0]), int(t[1])) for t in ts], size))
        except ValueError:
            return None

    return _mapped(one, "double", tiles)


def coverage_area(box: Column, open_sides: Column) -> Column:
    """Area of the frame around a connector's box [x0, y0, x1, y1], open sides left out."""
    return _mapped(lambda b, s: P.total(P.side_coverage(tuple(b), set(s))), "double", box, open_sides)


def ribbon_area(line: Column, thickness: Column) -> Column:
    """Area of a wall along a bent centre line, its bends mitred."""
    return _mapped(lambda ps, t: None if ps is None or t is None else P.total(P.ribbon(_points(ps), float(t))), "double", line, thickness)


def chained(lines: Column) -> Column:
    """Lines, as [ax, ay, bx, by], joined end to end where just two meet."""
    return _mapped(lambda ls: _listed(P.chained([((x[0], x[1]), (x[2], x[3])) for x in ls])), RINGS, lines)


def junction_area(lines: Column, thickness: Column) -> Column:
    """Area that the walls of each junction of ``lines`` share, drawn out to each other, all junctions together."""

    def mass(ls, t) -> float:
        walls = [((x[0], x[1]), (x[2], x[3]), float(t)) for x in ls]
        return sum(P.total(P.junction_mass(walls, p, [i, j], sine)) for p, i, j, _, sine in P.junctions([w[:2] for w in walls]))

    return _mapped(mass, "double", lines, thickness)
