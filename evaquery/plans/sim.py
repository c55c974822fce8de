"""Evacuation runs: a discrete one over tables, and a continuous one of many runs at once.

The discrete run moves agents over graph edges tick by tick, as table updates. The
continuous one steers agents in the plane; runs are independent, so each is a task of its
own and a study of thousands of runs is dealt over the cluster.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import small, stored

EVENTS = "run long, Step int, AgenteID string, Evento string, Valor string, Pos_X double, Pos_Y double"


def floor_left(walls: DataFrame, width: float, height: float) -> bool:
    """Whether some of the floor is under no wall (x0, y0, x1, y1): on the grid of the walls' own sides, a cell is free."""
    inside = walls.select(*[F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(most))).alias(c) for c, most in (("x0", width), ("y0", height), ("x1", width), ("y1", height))]).where("x1 > x0 and y1 > y0").distinct()
    boxes = np.array([tuple(r) for r in inside.collect()], dtype=float).reshape(-1, 4)
    xs, ys = (np.unique(np.concatenate([[0.0, float(most)], boxes[:, i], boxes[:, i + 2]])) for i, most in ((0, width), (1, height)))
    mx, my = (xs[:-1] + xs[1:]) / 2, (ys[:-1] + ys[1:]) / 2
    for x in mx:
        over = boxes[(boxes[:, 0] <= x) & (x <= boxes[:, 2])]
        if not ((over[:, 1, None] <= my) & (my <= over[:, 3, None])).any(axis=0).all():
            return True
    return False


def population(spark: SparkSession, n: int, width: float, height: float, walls: DataFrame, seed: int = 1) -> DataFrame:
    """(agent, profile, x, y): 70 % adults, 15 % rolling, 15 % elderly; nobody starts in a wall (x0, y0, x1, y1).

    Draws are hashes of the agent's number, so any partitioning gives the same crowd; a
    draw inside a wall, its border included, is replaced by the agent's next, in rounds of
    ten draws, until everybody stands. A floor that ``floor_left`` finds fully walled is an error.
    """
    if n > 0 and not floor_left(walls, width, height):
        raise ValueError("no floor is free of walls")
    draw = lambda *k: F.pmod(F.xxhash64("agent", *[F.lit(x) if not isinstance(x, str) else F.col(x) for x in k], F.lit(seed)), F.lit(1_000_000)) / 1e6
    solid = small(stored(walls.select("x0", "y0", "x1", "y1")))
    left, first, turn = spark.range(n).select(F.col("id").alias("agent")), None, 0
    while first is None or not left.isEmpty():
        tries = left.withColumn("k", F.explode(F.sequence(F.lit(10 * turn), F.lit(10 * turn + 9))))
        tries = tries.select("agent", "k", (draw("k", 1) * width).alias("x"), (draw("k", 2) * height).alias("y"))
        free = tries.join(solid, (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1")), "left_anti")
        placed = stored(free.groupBy("agent").agg(F.min(F.struct("k", "x", "y")).alias("p")))
        first = placed if first is None else first.unionByName(placed)
        left, turn = stored(left.join(placed, "agent", "left_anti")), turn + 1
    u = draw(3)
    return first.select("agent", F.when(u < 0.7, "Adult").when(u < 0.85, "Rolling").otherwise("Elderly").alias("profile"), "p.x", "p.y")


def activation(agents: DataFrame, step: int, seed: int = 1) -> DataFrame:
    """``agents`` with their place in the random order of a step; the same step and seed give the same order."""
    from ..operators.windows import global_row_number

    return global_row_number(agents.withColumn("__draw", F.xxhash64("agent", F.lit(step), F.lit(seed))), "__draw", "agent", name="place").drop("__draw")


def discrete(agents: DataFrame, routes: DataFrame, ticks: int, tick: float = 1.0, speed: float = 1.2, capacity: int = 3, alpha: float = 0.6) -> DataFrame:
    """(agent, leg, status, t): agents along fixed routes (agent, leg, u, v, length), slowed by who shares an edge.

    Each tick counts the agents on every undirected edge, works out the time that edge
    takes at that load, and moves those who have been on it long enough. An agent without
    a route is stuck. More than ``BROADCAST_ROWS`` legs meet agents by shuffle: their file is far smaller than they are.
    """
    legs = small(stored(routes.select("agent", "leg", F.least("u", "v").alias("eu"), F.greatest("u", "v").alias("ev"), "length")))
    last = legs.groupBy("agent").agg(F.max("leg").alias("last"))
    state = agents.select("agent").join(last, "agent", "left").select("agent", "last", F.lit(0).alias("leg"), F.lit(0.0).alias("spent"), F.when(F.col("last").isNull(), "stuck").otherwise("moving").alias("status"), F.lit(0).alias("t"))
    state = stored(state)
    for now in range(1, ticks + 1):
        if state.where("status = 'moving'").isEmpty():
            break
        at = state.join(legs, ["agent", "leg"], "left")
        load = stored(at.where("status = 'moving'").groupBy("eu", "ev").agg(F.count(F.lit(1)).alias("n")))
        at = at.join(small(load), ["eu", "ev"], "left")
        need = F.col("length") / speed * (1 + alpha * F.greatest(F.lit(0), F.col("n") - capacity) / max(1, capacity))
        spent = F.col("spent") + tick
        over = (F.col("status") == "moving") & (spent >= need)
        done = over & (F.col("leg") == F.col("last"))
        state = stored(at.select(
            "agent", "last", F.when(over & ~done, F.col("leg") + 1).otherwise(F.col("leg")).alias("leg"), F.when(over, 0.0).when(F.col("status") == "moving", spent).otherwise(F.col("spent")).alias("spent"),
            F.when(done, "done").otherwise(F.col("status")).alias("status"), F.when(done, now).otherwise(F.col("t")).alias("t"),
        ))
    return state.select("agent", "leg", "status", "t")


def walked(path: DataFrame, frames: int = 25) -> DataFrame:
    """(agent, leg, frame, x, y): positions along legs (agent, leg, ax, ay, bx, by), ``frames`` to each."""
    share = F.col("frame") / float(frames)
    each = path.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))
    return each.select("agent", "leg", "frame", (F.col("ax") + (F.col("bx") - F.col("ax")) * share).alias("x"), (F.col("ay") + (F.col("by") - F.col("ay")) * share).alias("y"))


def evacuated(positions: DataFrame, exits: DataFrame, radius: float = 2.0) -> DataFrame:
    """(agent, t): the first time an agent is within ``radius`` of an exit."""
    from ..operators.joins import within

    return within(positions.select("agent", "t", "x", "y"), exits.select("x", "y"), radius).groupBy(F.col("p_agent").alias("agent")).agg(F.min("p_t").alias("t"))


#: Pairs of neighbours that are worked out at once.
PAIRS = 1_000_000


def pushes(pos: np.ndarray, weight: np.ndarray, body: float, reach: float = 0.5) -> np.ndarray:
    """What those within ``reach`` push each body away, each as many times as its weight says; bodies on one spot do not push.

    Neighbours are looked for in the nine grid cells around, so work grows with those who
    are near and not with all pairs; a body's neighbours add up in their order.
    """
    force, own = np.zeros_like(pos), np.flatnonzero(np.isfinite(pos).all(axis=1))
    if len(own) < 2:
        return force
    at = np.floor(pos[own] / reach).astype(np.int64)
    at -= at.min(axis=0) - 1
    tall = int(at[:, 1].max()) + 2
    cell = at[:, 0] * tall + at[:, 1]
    order = np.argsort(cell, kind="stable")
    low, high = (np.stack([np.searchsorted(cell[order], cell + dx * tall + dy, side) for dx in (-1, 0, 1)], axis=1) for dy, side in ((-1, "left"), (1, "right")))
    many = high - low
    block = np.cumsum(many.sum(axis=1)) // PAIRS
    for rows in np.split(np.arange(len(own)), np.flatnonzero(np.diff(block)) + 1):
        n, start = many[rows].ravel(), low[rows].ravel()
        first = np.repeat(rows, many[rows].sum(axis=1))
        second = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)]
        inward = np.lexsort((second, first))
        i, j = own[first[inward]], own[second[inward]]
        apart = pos[i] - pos[j]
        gap = np.linalg.norm(apart, axis=1)
        near = (gap < reach) & (gap > 1e-3)
        i, j, apart, gap = i[near], j[near], apart[near], gap[near]
        push = apart / gap[:, None] * (1.5 * np.exp(-(gap - 2 * body)) * weight[j])[:, None]
        force += np.stack([np.bincount(i, push[:, k], len(pos)) for k in (0, 1)], axis=1)
    return force


def steer(pos: np.ndarray, vel: np.ndarray, goal: np.ndarray, limit: np.ndarray, walls: np.ndarray, body: float = 0.2, most: float = 6.0, weight: np.ndarray | None = None) -> np.ndarray:
    """New velocities of all agents, each as many as its weight says: pull to the goal, push from walls and from each other, inertia 0.7."""
    to = goal - pos
    far = np.linalg.norm(to, axis=1, keepdims=True)
    force = np.divide(to, far, out=np.zeros_like(to), where=far > 0)
    for ax, ay, bx, by in walls:
        d = np.array([bx - ax, by - ay])
        t = np.clip(((pos - (ax, ay)) @ d) / max(d @ d, 1e-9), 0, 1)[:, None]
        away = pos - (np.array([ax, ay]) + t * d)
        gap = np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-3)
        force += away / gap * 4 * np.exp(-8 * np.maximum(gap - body, 1e-3)) * (gap - body < 1.0)
    force += pushes(pos, np.ones(len(pos)) if weight is None else weight, body)
    size = np.linalg.norm(force, axis=1, keepdims=True)
    force = np.where(size > most, force / np.maximum(size, 1e-9) * most, force)
    vel = 0.7 * vel + 0.3 * force
    fast = np.linalg.norm(vel, axis=1, keepdims=True)
    return np.where(fast > limit[:, None], vel / np.maximum(fast, 1e-9) * limit[:, None], vel)


def continuous(runs: DataFrame, agents: DataFrame, exits: list[tuple[float, float]], walls: list[tuple[float, float, float, float]], steps: int) -> DataFrame:
    """The event log of every run (run): agents (run, agent, profile, x, y) head for their nearest exit.

    Agents within two metres of an exit are out. An agent that moved under 0.2 m in 20
    steps is stuck and replans to the next exit. Agents that start on one spot at one pace
    feel the same forces and stay together, so they move as one body of their number.
    """
    out, gates = np.array(exits, dtype=float), np.array(walls, dtype=float).reshape(-1, 4)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("agent")
        run, names = int(rows["run"].iloc[0]), rows["agent"].tolist()
        pace = 0.1 * rows["profile"].map({"Rolling": 1.2, "Elderly": 0.5}).fillna(1.0).to_numpy()
        _, start, of, weight = np.unique(np.column_stack([rows[["x", "y"]].to_numpy(float), pace]), axis=0, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(start)  # bodies in the order of their first agents
        of, weight, start = np.argsort(order)[of.ravel()], weight[order].astype(float), start[order]
        pos, limit = rows[["x", "y"]].to_numpy(float)[start], pace[start]
        vel, log, active = np.zeros_like(pos), [], np.ones(len(pos), dtype=bool)
        choice = np.array([int(np.argmin([math.dist(p, e) for e in out])) for p in pos])
        log += [(run, 0, str(n), "CAMBIO_RUTA", f"exit {c}", *p) for n, c, p in zip(names, choice[of], pos[of])]
        trail = [pos.copy()]
        for step in range(1, steps + 1):
            if not active.any():
                break
            vel[active] = steer(pos[active], vel[active], out[choice[active]], limit[active], gates, weight=weight[active])
            pos[active] += vel[active]
            trail = [*trail[-19:], pos.copy()]
            gone = active & (np.linalg.norm(pos - out[choice], axis=1) < 2.0)
            log += [(run, step, str(names[i]), "EVACUACION_COMPLETA", None, *pos[of[i]]) for i in np.flatnonzero(gone[of])]
            active &= ~gone
            if len(trail) == 20 and step % 20 == 0 and len(out) > 1:
                still = active & (np.linalg.norm(pos - trail[0], axis=1) < 0.2)
                choice[still] = (choice[still] + 1) % len(out)
                log += [(run, step, str(names[i]), "RECALCULO", f"exit {choice[of[i]]}", *pos[of[i]]) for i in np.flatnonzero(still[of])]
        return pd.DataFrame(log, columns=[c.split(" ")[0] for c in EVENTS.split(", ")])

    return runs.select("run").distinct().join(agents, "run").groupBy("run").applyInPandas(one, EVENTS)
