import datetime as dt

from pyspark.sql import functions as F

from evaquery.plans import cep
from evaquery.streaming import sensors

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def streamed(spark, tmp_path, rows, schema, build, mode="append", files=2):
    """Rows written as files, read as a stream file by file, into memory."""
    where = str(tmp_path / "in")
    step = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(where)
    name = "t" + str(abs(hash(str(tmp_path))))
    q = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where)).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


READING = "room string, sensor string, variable string, ts timestamp, value double"


def test_worked_example(spark):
    r = cep.room_states(spark.createDataFrame([("S-101", 5600.0, 1250.0, 32.0, 78.0, 1.0)], "room string, co2 double, tvoc double, temp double, hum double, jump double")).first()
    assert r.leak and not r.fire and r.t_max == 3.0 and r.state == "red" and r.sev_co2 == cep.RED and r.sev_tvoc == cep.ORANGE and r.sev_temp == cep.YELLOW
    quiet = cep.room_states(spark.createDataFrame([(500.0, 100.0, 20.0, 50.0)], "co2 double, tvoc double, temp double, hum double")).first()
    assert quiet.state == "green" and quiet.risk == 0 and quiet.t_max is None and quiet.reasons == []


def test_windows_find_the_peak(spark, tmp_path):
    rows = [tuple(r) for r in sensors.simulated(spark, 2, 240).select("room", "sensor", "variable", "ts", "value").orderBy("ts", "room", "variable").collect()]
    got = streamed(spark, tmp_path, rows, READING, lambda s: sensors.evaluated(sensors.windowed_rooms(sensors.deduplicated(s, "30 seconds"), late=None)))
    assert any(r.room == "S-0" and r.state == "red" and "leak" in r.reasons for r in got)
    assert all(r.state == "green" for r in got if r.room == "S-1")


def test_late_and_repeated_readings(spark, tmp_path):
    rows = [("a", "d", "co2", at(0), 1.0), ("a", "d", "co2", at(0), 1.0), ("a", "d", "co2", at(600), 1.0), ("a", "d", "co2", at(900), 1.0), ("a", "d", "co2", at(5), 9.0), ("a", "d", "co2", at(1200), 1.0), ("a", "d", "co2", at(1800), 1.0)]
    got = streamed(spark, tmp_path, rows, READING, lambda s: sensors.tumbling_states(sensors.deduplicated(s, "1 minute"), late=None), files=7)
    # lateness is judged by the watermark of the batch before the last
    assert {(r.start, r.n, r.most) for r in got} >= {(at(0), 1, 1.0), (at(600), 1, 1.0)}


def test_sessions(spark, tmp_path):
    rows = [("a", "d", "pir_count", at(s), 1.0) for s in (0, 60, 120, 900, 950, 5000)]
    got = streamed(spark, tmp_path, rows, READING, lambda s: sensors.presence_sessions(s, late="1 minute"), files=3)
    assert {(r.start, r.n) for r in got} == {(at(0), 3), (at(900), 2)}


def test_hysteresis_keeps_state_between_batches(spark, tmp_path):
    rows = [("a", "d", "v", at(i), v) for i, v in enumerate([10.0, 85.0, 70.0, 82.0, 65.0, 55.0, 70.0, 90.0])]
    got = streamed(spark, tmp_path, rows, READING, lambda s: sensors.hysteresis(s, 80, 60), files=4)
    assert [(r.ts, r.active) for r in sorted(got, key=lambda r: r.ts)] == [(at(1), True), (at(5), False), (at(7), True)]


def test_throttle(spark, tmp_path):
    rows = [("7", at(s)) for s in (0, 1, 2, 3, 5, 6)]
    got = streamed(spark, tmp_path, rows, "agent string, ts timestamp", lambda s: sensors.throttled(s, 2.0), files=3)
    assert sorted(r.ts for r in got) == [at(0), at(2), at(5)]


def test_upserts_are_repeatable(spark, tmp_path):
    sink = sensors.CurrentReadings(str(tmp_path / "t"))
    schema = "room string, variable string, ts timestamp, event_id long, value double"
    first = spark.createDataFrame([("a", "co2", at(0), 1, 1.0), ("b", "co2", at(0), 2, 2.0)], schema)
    second = spark.createDataFrame([("a", "co2", at(5), 3, 3.0), ("b", "co2", at(-5), 4, 9.0)], schema)
    for batch, i in ((first, 0), (second, 1), (second, 1)):
        sink(batch, i)
    assert {(r.room, r.value) for r in sink.read(spark).collect()} == {("a", 3.0), ("b", 2.0)}
    assert spark.read.parquet(str(tmp_path / "t/history")).count() == 4


def test_refresh_order(spark):
    calls = []
    build = lambda name, have: calls.append(name) or have["cells"].select(F.lit(name).alias("n"))
    out = sensors.refreshed(build, {"boundaries": {"cells"}, "nodes": {"cells"}, "edges": {"boundaries", "nodes"}, "other": {"elsewhere"}}, {"cells"}, {"cells": spark.range(1).toDF("c")})
    assert calls == ["boundaries", "nodes", "edges"] and set(out) == {"cells", "boundaries", "nodes", "edges"}


def stepped(spark, tmp_path, steps, schema, build):
    """The rows that a stream gives for each step of rows, and the rows of state after it; a query goes on from its checkpoint."""
    out, states = [], []
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        made = build(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        seen = []
        q = made.writeStream.foreachBatch(lambda b, _: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()  # noqa: B023
        q.awaitTermination(120)
        assert q.exception() is None
        out.append(sorted(seen))
        states.append(sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]))
    return out, states


def test_silent_rooms_go_off_and_leave_no_state(spark, tmp_path):
    steps = [[("a", at(0), 90.0), ("b", at(0), 90.0), ("c", at(0), 10.0)], [("b", at(100), 70.0)], [("b", at(400), 70.0)], [("b", at(401), 10.0)], [("z", at(2000), 0.0)]]
    out, states = stepped(spark, tmp_path, steps, "room string, ts timestamp, value double", lambda s: sensors.hysteresis(s, 80, 60, forget=200.0, late="1 second"))
    flat = sorted(r for step in out for r in step)
    assert flat == [("a", at(0), True), ("a", at(200), False), ("b", at(0), True), ("b", at(300), False)]
    assert states[0] > states[-1] == 0


def test_throttled_agents_are_forgotten(spark, tmp_path):
    steps = [[("a", at(0)), ("b", at(1))], [("a", at(1)), ("a", at(60))], [("c", at(500))], [("c", at(501)), ("a", at(502))], [("z", at(5000))], [("z", at(9000))]]
    out, states = stepped(spark, tmp_path, steps, "agent string, ts timestamp", lambda s: sensors.throttled(s, 30.0, late="1 second"))
    assert sorted(r for step in out for r in step) == sorted([("a", at(0)), ("b", at(1)), ("a", at(60)), ("c", at(500)), ("a", at(502)), ("z", at(5000)), ("z", at(9000))])
    assert max(states) > states[-1] and states[-1] <= 3


def test_batches_rewrite_their_buckets_only(spark, tmp_path):
    sink = sensors.CurrentReadings(str(tmp_path / "t"), buckets=16)
    schema = "room string, variable string, ts timestamp, event_id long, value double"
    sink(spark.createDataFrame([(f"r{i}", "co2", at(0), i, 1.0) for i in range(100)], schema), 0)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.glob("t/current/bucket=*/*.parquet")}
    sink(spark.createDataFrame([("r7", "co2", at(5), 200, 2.0)], schema), 1)
    kept = [p for p, t in before.items() if p.exists() and p.stat().st_mtime_ns == t]
    assert len(before) > 10 and len(kept) == len(before) - 1
    rows = {r.room: r.value for r in sink.read(spark).collect()}
    assert len(rows) == 100 and rows["r7"] == 2.0 and sum(rows.values()) == 101.0
