"""Scalar rules of the domain as column expressions; arguments are columns unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def rounded6(x: Column) -> Column:
    """Six decimals, never a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def window_score(kind: Column, t: Column, start: Column, dur: Column, v1: Column, v2: Column) -> Column:
    """Score of one window at time t; null outside it, for an unknown kind, or a triangle without duration.

    hold: v1 all along. ramp: from 1 to v1. triangle: 1 (v2) down to v1 at half time and back.
    """
    inside = (t >= start) & (t <= start + dur)
    share = F.when(dur > 0, (t - start) / dur).otherwise(F.lit(1.0))
    top = F.coalesce(v2, F.lit(1.0))
    triangle = F.when(share <= 0.5, lerp(top, v1, share * 2)).otherwise(lerp(v1, top, share * 2 - 1))
    return F.when(~inside, None).when(kind == "hold", v1).when(kind == "ramp", lerp(F.lit(1.0), v1, share)).when((kind == "triangle") & (dur > 0), triangle)


def risk_weight(w: Column, score_u: Column, score_v: Column, beta: float = 2.0) -> Column:
    return w * (1 + beta * F.greatest(1 - score_u, 1 - score_v))


def cost_base(w: Column, risk: Column, beta: float = 2.0) -> Column:
    """What of a risk weight is distance; the rest is penalty."""
    return w / (1 + beta * risk)


def congested_time(length: Column, n: Column, speed: float = 1.2, capacity: int = 3, alpha: float = 0.6) -> Column:
    return length / speed * (1 + alpha * F.greatest(F.lit(0), n - capacity) / max(1, capacity))


def edge_capacity(width: Column) -> Column:
    return F.greatest(F.lit(1.0), F.round(width / 0.6, 2))


def edge_weight(distance: Column) -> Column:
    return F.when(distance > 0, F.round(distance, 6)).otherwise(1.0)


def legacy_weight(distance: Column, kind: Column) -> Column:
    return F.when(kind == "door_to_door", distance * 0.8).otherwise(distance * 1.5)


def profile_speed(profile: Column) -> Column:
    return 0.1 * F.when(profile == "Rolling", 1.2).when(profile == "Elderly", 0.5).otherwise(1.0)


def hazard_weight(w: Column, risk: Column, minutes: Column, t_max: Column, k: float = 3.0, block: float = 0.85) -> Column:
    """Weight behind a hazard; null where the edge is blocked."""
    return F.when((risk >= block) | F.coalesce(minutes > t_max, F.lit(False)), None).otherwise(w * (1 + k * risk))


def arrival_radius(kind: Column) -> Column:
    return F.when(kind.isin("door", "exit"), 0.25).when(kind == "virtual", 1.0).otherwise(1.2)


def turn_factor(dot: Column) -> Column:
    """What a turn leaves of the speed limit."""
    return F.when(dot < 0, 0.3).when(dot < 0.5, 0.6).when(dot < 0.86, 0.85).otherwise(1.0)


def wall_force(d: Column) -> Column:
    return F.least(4 * F.exp(-8 * d), F.lit(6.0))


def social_force(d: Column) -> Column:
    return F.least(1.5 * F.exp(-d), F.lit(6.0))


def dynamic_tolerance(base: float, alpha: float, severity: Column) -> Column:
    return base + alpha * severity


def crowd_tolerance(n: Column, expected: Column) -> Column:
    return F.greatest(F.lit(0.3), 1 - n / expected)


def inverse_width(w: Column, least: Column, most: Column) -> Column:
    """Line width that falls from 5 to 1 as the weight rises."""
    return 1 + 4 * (most - w) / (most - least + 1e-9)


def score_class(score: Column, threshold: float) -> Column:
    return F.when(F.coalesce(score, F.lit(1.0)) < threshold, "grey").otherwise("graded")


def weight_class(w: Column) -> Column:
    return F.when(w > 2000, "red").when(w > 20, "yellow").otherwise("cyan")


def locomotion_list(values: Column) -> Column:
    """Allowed locomotion types, case and synonyms aside, each once; walking and rolling if none."""
    known = F.create_map(*[F.lit(x) for pair in (("flying", "Flying"), ("rolling", "Rolling"), ("walking", "Walking"), ("unspecified", "Unspecified"), ("step", "Walking"), ("stairs", "Walking")) for x in pair])
    made = F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.try_element_at(known, F.lower(F.trim(v)))), lambda v: v.isNotNull()))
    return F.when(F.size(made) == 0, F.array(F.lit("Walking"), F.lit("Rolling"))).otherwise(made)


def shared_locomotion(a: Column, b: Column) -> Column:
    """What both allow, else what either allows, else unspecified; ascending."""
    both, either = F.array_intersect(a, b), F.array_union(a, b)
    return F.array_sort(F.when(F.size(both) > 0, both).when(F.size(either) > 0, either).otherwise(F.array(F.lit("Unspecified"))))


def space_class(name: Column, klass: Column, category: Column) -> Column:
    """struct(type, category, function) of a space by its name and attributes."""
    low, own = F.lower(name), F.lower(F.coalesce(category, F.lit("")))
    made = lambda t, c, f: F.struct(F.lit(t).alias("type"), c.alias("category"), F.lit(f).alias("function"))
    other = lambda text: F.when(own == "", text).otherwise(own)
    return (
        F.when(low.contains("salida"), made("exit_space", F.lit("exit"), "ExitSpace"))
        .when(low.contains("frontera"), made("transfer_space", F.lit("virtual_boundary"), "VirtualBoundary"))
        .when(low.contains("puerta") | (own == "door"), made("transfer_space", F.lit("door_space"), "ConnectionSpace"))
        .when(klass == "TransferSpace", made("transfer_space", other("transfer_space"), "ConnectionSpace"))
        .when(klass == "AnchorSpace", made("exit_space", F.lit("exit"), "ExitSpace"))
        .otherwise(made("navigable_space", other("room"), "General"))
    )


def boundary_role(type_a: Column, type_b: Column, blocked: Column, wall_a: Column, wall_b: Column) -> Column:
    """Role of the contact of two cells, by their navigation types; null for none."""
    pair = F.array_sort(F.array(type_a, type_b))
    holds = lambda t: F.array_contains(pair, t)
    closed = holds("NonNavigableSpace") | holds("ObjectSpace")
    return (
        F.when(holds("GeneralSpace") & holds("TransferSpace"), F.when(F.coalesce(blocked, F.lit(False)), "general_transfer_contact_blocked").otherwise("general_transfer_contact"))
        .when(holds("GeneralSpace") & closed, "general_non_navigable_contact")
        .when(holds("TransferSpace") & holds("NonNavigableSpace"), "transfer_non_navigable_contact")
        .when((type_a == "NonNavigableSpace") & (type_b == "NonNavigableSpace") & wall_a & wall_b, "internal_wall_contact")
    )


def event_span(t0: Column, n: Column, step: float, shape: Column, recover: float = 25.0, ramp_down: float = 6.0, hold: float = 12.0, ramp_up: float = 8.0) -> Column:
    """struct(start, stop) of a sequence of phases."""
    last = F.when(shape == "triangle", recover).otherwise(ramp_down + hold + ramp_up)
    return F.struct(t0.alias("start"), (t0 + (n - 1) * step + last).alias("stop"))


def path_text(path: Column) -> Column:
    """a -> b -> c, a place that repeats its predecessor left out."""
    return F.array_join(F.filter(path, lambda x, i: (i == 0) | (x != F.get(path, i - 1))), " -> ")


def _is_virtual(low: Column) -> Column:
    return low.contains("frontera")


def node_type(name: Column) -> Column:
    """Type of a graph node by its name."""
    low = F.lower(name)
    return F.when(low.contains("salida"), "exit_space").when(_is_virtual(low), "virtual_boundary").when(low.contains("puerta"), "door_space").otherwise("space")


def connector_type(origin: Column, target: Column) -> Column:
    """What a link leads through, by the names of its ends."""
    types = F.array(node_type(origin), node_type(target))
    return F.when(F.array_contains(types, "exit_space"), "emergency_exit").when(F.array_contains(types, "virtual_boundary"), "virtual_boundary").otherwise("door_passage")


def through_space(origin: Column, target: Column) -> Column:
    """The first end that is a door, an exit or a virtual boundary by its name; null for none."""
    leads = lambda n: node_type(n) != "space"
    return F.when(leads(origin), origin).when(leads(target), target)


def exterior_role(navigation_type: Column, function: Column, wall_types: Column) -> Column:
    """Role of a cell's border to the outside: anchor, outer shell, or null."""
    wall = (navigation_type == "NonNavigableSpace") & (function == "Wall")
    return F.when((navigation_type == "TransferSpace") & (function == "AnchorSpace"), "exterior_anchor").when(wall & F.coalesce(F.array_contains(wall_types, "muro_exterior"), F.lit(False)), "outer_shell")


def utc_text(ts: Column) -> Column:
    """A time in UTC to the second, ISO 8601 with Z; a timestamp without zone is taken for UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def velocity(vx: Column, vy: Column, fx: Column, fy: Column, limit: Column, inertia: float = 0.7) -> Column:
    """struct(x, y): the velocity after a force, no faster than ``limit``."""
    x, y = inertia * vx + (1 - inertia) * fx, inertia * vy + (1 - inertia) * fy
    fast = F.hypot(x, y)
    part = F.when(fast > limit, limit / fast).otherwise(1.0)
    return F.struct((x * part).alias("x"), (y * part).alias("y"))


#: Profiles of the offline simulation: least score, allowed locomotion, whether general spaces without one may be walked.
PROFILES = {"GENERAL": (0.60, ("WALK", "RAMP"), True), "PMR": (0.75, ("RAMP",), False)}
