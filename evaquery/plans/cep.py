"""Sensor rules: severities, complex events, exposure limits and risk; the same columns in batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GREEN, YELLOW, ORANGE, RED = range(4)
#: Normalised severity, and the weights of CO2, TVOC, heat and pressure.
NORMAL = (0.0, 0.33, 0.66, 1.0)
WEIGHTS = {"co2": 0.25, "tvoc": 0.25, "temp": 0.35, "pres": 0.15}


def severity_co2(x: Column) -> Column:
    return F.when(x > 5000, RED).when(x > 2000, ORANGE).when(x >= 1000, YELLOW).otherwise(GREEN)


def severity_iaq(x: Column, calibrated: Column | None = None) -> Column:
    """A sensor out of calibration loses a level."""
    level = F.when(x > 150, ORANGE).when(x > 100, YELLOW).otherwise(GREEN)
    return level if calibrated is None else F.greatest(level - F.when(calibrated, 0).otherwise(1), F.lit(GREEN))


def severity_tvoc(x: Column) -> Column:
    return F.when(x > 3000, RED).when(x > 1000, ORANGE).when(x >= 500, YELLOW).otherwise(GREEN)


def severity_heat(t: Column, humidity: Column) -> Column:
    """Heat with humidity counts one level more."""
    level = F.when(t >= 60, RED).when(t >= 50, ORANGE).otherwise(GREEN)
    return F.least(level + F.when((t > 30) & (humidity > 70), 1).otherwise(0), F.lit(RED))


def severity_humidity(x: Column) -> Column:
    return F.when((x < 30) | (x > 70), YELLOW).otherwise(GREEN)


def severity_light(x: Column, least: float = 5.0) -> Column:
    return F.when(x < least, YELLOW).otherwise(GREEN)


def severity_pressure(jump: Column, least: float = 5.0) -> Column:
    return F.when(F.abs(jump) > least, ORANGE).otherwise(GREEN)


def minutes_allowed(co2: Column, iaq: Column, tvoc: Column, t: Column) -> Column:
    """The least exposure limit of those that apply, in minutes; null for none."""
    return F.least(
        F.when(co2 > 10000, 2.0).when(co2 > 5000, 3.0), F.when(iaq > 150, 5.0).when(iaq > 100, 20.0),
        F.when(tvoc > 3000, 2.0).when(tvoc > 1000, 5.0).when(tvoc >= 500, 10.0), F.when(t > 70, 0.5).when(t >= 60, 1.0).when(t >= 50, 3.0),
    )


def fire(heat: Column, tvoc: Column, iaq: Column) -> Column:
    return (heat >= ORANGE) & ((tvoc >= YELLOW) | (iaq >= YELLOW))


def gas_leak(tvoc: Column, co2: Column, pressure: Column) -> Column:
    return (tvoc >= ORANGE) & ((co2 >= YELLOW) | (pressure == ORANGE))


def shock(pressure: Column, heat: Column) -> Column:
    return (pressure == ORANGE) & (heat >= YELLOW)


def extreme_heat(t: Column, humidity: Column) -> Column:
    return (t > 40) & (humidity > 80)


def normal(severity: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NORMAL)), (severity + 1).cast("int"))


def risk(**severities: Column) -> Column:
    """1 - product of (1 - weight * normalised severity) of the named variables."""
    left = F.lit(1.0)
    for name, s in severities.items():
        left = left * (1 - WEIGHTS[name] * normal(s))
    return 1 - left


def room_states(rooms: DataFrame) -> DataFrame:
    """Adds severities, events, severity, t_max, risk, state and reasons to rows (co2, tvoc, temp, hum, and iaq, jump, light if there)."""
    has = lambda c: F.col(c) if c in rooms.columns else F.lit(None).cast("double")
    s = rooms.select(
        "*", severity_co2(F.col("co2")).alias("sev_co2"), severity_tvoc(F.col("tvoc")).alias("sev_tvoc"), severity_heat(F.col("temp"), F.col("hum")).alias("sev_temp"),
        severity_iaq(has("iaq")).alias("sev_iaq"), severity_pressure(has("jump")).alias("sev_pres"), severity_light(has("light")).alias("sev_light"),
    )
    c = {n: F.col(f"sev_{n}") for n in ("co2", "tvoc", "temp", "iaq", "pres", "light")}
    s = s.withColumn("fire", fire(c["temp"], c["tvoc"], c["iaq"])).withColumn("leak", gas_leak(c["tvoc"], c["co2"], c["pres"])).withColumn("shock", shock(c["pres"], c["temp"]))
    complex_ = F.col("fire") | F.col("leak") | F.col("shock")
    s = s.withColumn("severity", F.when(complex_, RED).otherwise(F.greatest(*c.values()))).withColumn("t_max", minutes_allowed(F.col("co2"), has("iaq"), F.col("tvoc"), F.col("temp")))
    s = s.withColumn("risk", F.when(F.col("fire") | F.col("shock"), 1.0).otherwise(risk(co2=c["co2"], tvoc=c["tvoc"], temp=c["temp"], pres=c["pres"])))
    names = F.array(*map(F.lit, ("green", "yellow", "orange", "red")))
    reasons = F.array_compact(F.array(*[F.when(F.col(e), F.lit(e)) for e in ("fire", "leak", "shock")], *[F.when(x >= YELLOW, F.lit(n)) for n, x in c.items()]))
    return s.withColumn("state", F.element_at(names, F.col("severity") + 1)).withColumn("reasons", reasons)


def upserted(current: DataFrame, arrived: DataFrame) -> DataFrame:
    """The newest row of each (room, variable) of both, the greater event id at equal times."""
    from ..operators.windows import latest

    return latest(current.unionByName(arrived), ["room", "variable"], "ts", "event_id")
