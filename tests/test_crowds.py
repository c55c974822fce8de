import numpy as np
import pytest

from evaquery.plans import sim


def all_pairs(pos, weight, body=0.2):
    apart = pos[:, None] - pos[None]
    gap = np.linalg.norm(apart, axis=2)
    near = (gap < 0.5) & (gap > 1e-3)
    return (np.divide(apart, gap[..., None], out=np.zeros_like(apart), where=near[..., None]) * (1.5 * np.exp(-(gap - 2 * body)) * weight)[..., None]).sum(axis=1)


@pytest.mark.parametrize(("n", "wide"), [(0, 1.0), (1, 1.0), (2, 0.3), (300, 6.0), (300, 0.4)])
def test_pushes_of_neighbours_are_those_of_all_pairs(n, wide, monkeypatch):
    draw = np.random.default_rng(n)
    pos, weight = draw.random((n, 2)) * wide - wide / 2, draw.integers(1, 9, n).astype(float)
    want = all_pairs(pos, weight)
    assert np.array_equal(sim.pushes(pos, weight, 0.2), want)
    monkeypatch.setattr(sim, "PAIRS", 100)
    assert np.array_equal(sim.pushes(pos, weight, 0.2), want)


def test_neighbours_are_not_looked_for_among_all_bodies():
    """A million bodies a metre apart: all pairs would be 8 TB of gaps."""
    pos = np.stack(np.meshgrid(np.arange(1000.0), np.arange(1000.0)), axis=-1).reshape(-1, 2)
    assert not sim.pushes(pos, np.ones(len(pos)), 0.2).any()


def test_agents_of_one_spot_and_pace_move_as_one_body_and_are_all_logged(spark):
    agents = spark.range(60_000).selectExpr("0L as run", "id as agent", "'Adult' as profile", "cast(id % 3 + 1 as double) as x", "1.0D as y")
    log = sim.continuous(agents.select("run"), agents, [(8.0, 1.0)], [], 100).groupBy("Evento").count().collect()
    assert {r.Evento: r["count"] for r in log} == {"CAMBIO_RUTA": 60_000, "EVACUACION_COMPLETA": 60_000}
