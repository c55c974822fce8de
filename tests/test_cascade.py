"""The rebuild by regions against the rebuild of everything."""

import random

import pytest

from evaquery.plans import cascade

CELL = "cell long, level int, x0 int, y0 int, x1 int, y1 int"


def floor(seed, n=14):
    """Rooms of a grid, some joined, on three levels; lines repeat between levels."""
    rnd = random.Random(seed)
    return [(level * 1000 + i * n + j, level, i * 10, j * 10, i * 10 + 10, j * 10 + rnd.choice([10, 10, 8])) for level in range(3) for i in range(n) for j in range(n) if rnd.random() < 0.8]


def changed(cells, seed):
    rnd = random.Random(seed)
    out = []
    for cell in cells:
        x = rnd.random()
        if x < 0.02:
            continue
        out.append((cell[0], (cell[1] + 1) % 3, *cell[2:]) if x < 0.03 else (*cell[:4], cell[4] - 2, cell[5]) if x < 0.05 else cell)
    return out + [(90_000, 1, -35, -20, -25, -10), (90_001, 1, -25, -20, -15, -10), (90_002, 0, 500, 3, 503, 900)]


def rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("size", [16, 64])
def test_cascade_gives_the_full_rebuild(spark, size):
    old, new = (spark.createDataFrame(x, CELL) for x in (floor(1), changed(floor(1), 2)))
    have = cascade.derived(old, size)
    want, got = cascade.derived(new, size), cascade.cascaded(old, new, have, size)
    for kind in cascade.KINDS:
        assert rows(got[kind]) == rows(want[kind]) != rows(have[kind])


def test_nothing_changed_and_no_cells(spark):
    old, none = spark.createDataFrame(floor(1, 4), CELL), spark.createDataFrame([], CELL)
    have = cascade.derived(old, 16)
    assert cascade.dirty_regions(old, old, 16).count() == 0
    assert all(rows(v) == rows(have[k]) for k, v in cascade.cascaded(old, old, have, 16).items())
    assert all(v.count() == 0 for v in cascade.cascaded(old, none, have, 16).values())
    assert all(rows(v) == rows(have[k]) for k, v in cascade.cascaded(none, old, cascade.derived(none, 16), 16).items())


def test_store_rewrites_touched_regions_only(spark, tmp_path):
    old, new = floor(5), changed(floor(5), 6)
    store = cascade.TopologyStore(spark, f"{tmp_path}/topology", 32)
    store.create(spark.createDataFrame(old, CELL))
    before = {p: p.stat().st_mtime_ns for p in tmp_path.glob("topology/*/region=*/*.parquet")}
    was, now = {c[0]: c for c in old}, {c[0]: c for c in new}
    moved = [(*c, False) for k, c in now.items() if was.get(k) != c] + [(k, None, None, None, None, None, True) for k in was if k not in now]
    changes = spark.createDataFrame(moved, CELL + ", gone boolean")
    dirty = store.change(changes)
    touched = {f"region={r.rx}_{r.ry}" for r in dirty.collect()}
    want = cascade.derived(spark.createDataFrame(new, CELL), 32)
    for kind in cascade.KINDS:
        assert rows(store.read(kind)) == rows(want[kind])
    for path, at in before.items():
        assert path.parent.name in touched or path.stat().st_mtime_ns == at
    assert {p.parent.name for p in before} - touched
    plan = store.read("edges", dirty.limit(2))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [region" in plan
    assert store.change(changes).count() == 0  # the same batch again finds nothing to do
    for kind in cascade.KINDS:
        assert rows(store.read(kind)) == rows(want[kind])
