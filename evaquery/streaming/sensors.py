"""Sensor streams: windows with late data bounded, hysteresis, throttled replanning, upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans import cep
from ..sources.storage import stored

VARIABLES = ("co2", "iaq", "tvoc", "air_temperature", "air_humidity", "barometric_pressure", "ambient_light")


def _bounded(readings: DataFrame, late: str | None) -> DataFrame:
    """The stream with a watermark; None leaves the one it has, for a stream can have only one."""
    return readings.withWatermark("ts", late) if late else readings


def deduplicated(readings: DataFrame, late: str | None = "2 minutes") -> DataFrame:
    """Readings once each by (sensor, variable, ts); those later than ``late`` are dropped, so state stays bounded."""
    return _bounded(readings, late).dropDuplicatesWithinWatermark(["sensor", "variable", "ts"])


def windowed_rooms(readings: DataFrame, size: str = "30 seconds", slide: str = "10 seconds", late: str | None = "2 minutes") -> DataFrame:
    """(room, start, stop, a column a variable): means of each variable in sliding windows, for the sensor rules.

    A mean, not a median: it merges before the shuffle and keeps two numbers of state a key.
    """
    means = [F.avg(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in VARIABLES]
    jump = (F.max(F.when(F.col("variable") == "barometric_pressure", F.col("value"))) - F.min(F.when(F.col("variable") == "barometric_pressure", F.col("value")))).alias("jump")
    wide = _bounded(readings, late).groupBy("room", F.window("ts", size, slide).alias("w")).agg(*means, jump)
    return wide.select("room", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *VARIABLES, "jump")


def evaluated(rooms: DataFrame) -> DataFrame:
    """(room, ts, risk, t_max, state, reasons) of windowed rooms; a variable without readings is harmless."""
    named = rooms.select(
        "room", F.col("stop").alias("ts"), F.coalesce("co2", F.lit(0.0)).alias("co2"), F.coalesce("iaq", F.lit(0.0)).alias("iaq"), F.coalesce("tvoc", F.lit(0.0)).alias("tvoc"),
        F.coalesce("air_temperature", F.lit(20.0)).alias("temp"), F.coalesce("air_humidity", F.lit(50.0)).alias("hum"), F.coalesce("jump", F.lit(0.0)).alias("jump"), F.coalesce("ambient_light", F.lit(100.0)).alias("light"),
    )
    return cep.room_states(named).select("room", "ts", "risk", "t_max", "state", "reasons")


def tumbling_states(readings: DataFrame, size: str = "5 minutes", late: str | None = "2 minutes") -> DataFrame:
    w = F.window("ts", size)
    return _bounded(readings, late).groupBy("room", "variable", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most")).select("room", "variable", F.col("w.start").alias("start"), "n", "mean", "most")


def presence_sessions(readings: DataFrame, gap: str = "5 minutes", late: str | None = "10 minutes") -> DataFrame:
    """(room, start, stop, n): stretches of presence without a gap."""
    seen = _bounded(readings.where("variable = 'pir_count' and value > 0"), late)
    return seen.groupBy("room", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("room", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


class _Switch(StatefulProcessor):
    """A switch a key, on at ``high`` and off under ``low``; a switch that is on is held, one that is off is no state."""

    def __init__(self, high: float, low: float, forget: float | None) -> None:
        self.high, self.low, self.forget = high, low, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.on = handle.getValueState("on", "on boolean")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        active, out = self.on.exists(), []
        timer = until = self.timer.get()[0] if self.timer.exists() else None
        for ts, value in sorted((ts, v) for part in rows for ts, v in zip(part["ts"], part["value"])):
            at = int(ts.timestamp() * 1000)
            if active and until is not None and at > until:
                active = False
                out.append((key[0], pd.Timestamp(until, unit="ms"), False))
            now = True if value >= self.high else False if value < self.low else active
            if now != active:
                active = now
                out.append((key[0], ts, active))
            until = None if self.forget is None else at + int(self.forget * 1000)
        if timer is not None:
            self.handle.deleteTimer(timer)
            self.timer.clear()
        if not active:
            self.on.clear()
        else:
            self.on.update((True,))
            if until is not None:
                self.handle.registerTimer(until)
                self.timer.update((until,))
        yield pd.DataFrame(out, columns=["room", "ts", "active"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        was = self.on.exists()
        self.on.clear()
        self.timer.clear()
        yield pd.DataFrame([(key[0], pd.Timestamp(at, unit="ms"), False)] if was else [], columns=["room", "ts", "active"])

    def close(self) -> None:
        pass


class _Throttle(StatefulProcessor):
    """The time of a key's last request that was let through, held as long as it can hold one back."""

    def __init__(self, seconds: float, ends: bool) -> None:
        self.seconds, self.ends = seconds, ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = last = self.last.get()[0] if self.last.exists() else None
        out = []
        for ts in sorted(ts for part in rows for ts in part["ts"]):
            if last is None or ts.timestamp() - last >= self.seconds:
                last = ts.timestamp()
                out.append((key[0], ts))
        if last != before:
            due = lambda at: int((at + self.seconds) * 1000)
            if self.ends:
                if before is not None:
                    self.handle.deleteTimer(due(before))
                self.handle.registerTimer(due(last))
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["agent", "ts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame([], columns=["agent", "ts"])

    def close(self) -> None:
        pass


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(spark: SparkSession) -> None:
    """Keyed state with timers needs this store; a session that names another for its streams cannot have both."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def hysteresis(readings: DataFrame, high: float, low: float, forget: float | None = None, late: str = "2 minutes") -> DataFrame:
    """(room, ts, active): changes of a switch that goes on at ``high`` and off under ``low``.

    Only switches that are on are state. With ``forget``, a room that has been silent for so
    many seconds, by the stream's own time, goes off at that time and leaves no state;
    readings later than ``late`` may then come too late. Without, a room that stays on stays held.
    """
    _stateful(readings.sparkSession)
    own = (readings if forget is None else _bounded(readings, late)).select("room", "ts", "value").groupBy("room")
    return own.transformWithStateInPandas(_Switch(high, low, forget), "room string, ts timestamp, active boolean", "append", "none" if forget is None else "eventTime")


def throttled(requests: DataFrame, seconds: float = 2.0, late: str | None = None) -> DataFrame:
    """(agent, ts): replan requests of an agent at least ``seconds`` apart; the last time is the state.

    With ``late``, the watermark of the stream, a time is forgotten as soon as no request
    that can still come could be held back by it.
    """
    _stateful(requests.sparkSession)
    own = (requests if late is None else _bounded(requests, late)).select("agent", "ts").groupBy("agent")
    return own.transformWithStateInPandas(_Throttle(seconds, late is not None), "agent string, ts timestamp", "append", "none" if late is None else "eventTime")


class CurrentReadings:
    """For ``foreachBatch``: the newest reading of each (room, variable), in folders by a hash of the key, and all readings in a history by batch.

    A batch reads and replaces the buckets that its own keys fall into, by dynamic partition
    overwrite, and writes its own part of the history; what it writes follows its keys and
    not the table. The newest of two readings is the same whichever comes first, so a batch
    that is run again, or in part, gives the same table.
    """

    def __init__(self, path: str, buckets: int = 64) -> None:
        self.path, self.buckets = path, buckets

    def _there(self, spark: SparkSession) -> bool:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/current")
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def read(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets, whose folders alone are read; None before the first batch."""
        if not self._there(spark):
            return None
        whole = spark.read.parquet(f"{self.path}/current")
        return (whole if buckets is None else whole.where(F.col("bucket").isin(buckets))).drop("bucket")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = batch.select("room", "variable", "ts", "event_id", "value")
        own.write.mode("overwrite").parquet(f"{self.path}/history/batch={batch_id}")
        own = spark.read.schema(own.schema).parquet(f"{self.path}/history/batch={batch_id}")
        bucket = F.pmod(F.xxhash64("room", "variable"), F.lit(self.buckets)).cast("int").alias("bucket")
        touched = [r["bucket"] for r in own.select(bucket).distinct().collect()]
        had = self.read(spark, touched)
        merged = stored(cep.upserted(own.limit(0) if had is None else had, own).select("*", bucket))
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/current")


def simulated(spark: SparkSession, rooms: int, seconds: int, seed: int = 1) -> DataFrame:
    """A repeatable sensor day: base levels with noise, and a gas peak in room 0 half way."""
    base = F.create_map(*[F.lit(x) for kv in {"co2": 600.0, "iaq": 50.0, "tvoc": 200.0, "air_temperature": 22.0, "air_humidity": 45.0, "barometric_pressure": 1013.0}.items() for x in kv])
    each = spark.range(rooms).select(F.col("id").alias("r")).join(spark.range(seconds).select(F.col("id").alias("s")), how="cross").select("r", "s", F.explode(base).alias("variable", "level"))
    noise = (F.pmod(F.xxhash64("r", "s", "variable", F.lit(seed)), F.lit(1000)) / 1000.0 - 0.5) * F.when(F.col("variable") == "barometric_pressure", 0.001).otherwise(0.1)
    peak = F.when((F.col("r") == 0) & F.col("variable").isin("co2", "tvoc") & F.col("s").between(seconds // 2, seconds // 2 + 60), 9.0).otherwise(1.0)
    return each.select(F.concat(F.lit("S-"), F.col("r").cast("string")).alias("room"), F.concat_ws("-", F.lit("d"), F.col("r").cast("string")).alias("sensor"), "variable", F.timestamp_seconds(F.col("s")).alias("ts"), (F.col("level") * (1 + noise) * peak).alias("value"))


def refreshed(build, triggers: dict[str, set[str]], changed: set[str], have: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Recomputes what depends on ``changed`` tables, in the order of ``triggers`` (name -> inputs), and keeps the rest."""
    out, dirty = dict(have), set(changed)
    for name, inputs in triggers.items():
        if inputs & dirty:
            out[name] = stored(build(name, out))
            dirty.add(name)
    return out
