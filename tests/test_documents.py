import json

from pyspark.sql import functions as F

from evaquery.sources import documents, sinks

MODEL = {
    "modelName": "two rooms",
    "levels": [{"id": "LEVEL_00", "order": 0, "floorZ": 0.0}],
    "cells": [{"id": "CS_A", "level": "LEVEL_00", "navigationType": "GeneralSpace", "boundedBy": ["L:B:CB_1"]}, {"id": "CS_B", "level": "LEVEL_00", "navigationType": "GeneralSpace"}],
    "boundaries": [{"id": "CB_1", "isVirtual": False, "cellRefs": ["L:P:CS_A", "L:P:CS_B"], "traversable": True}],
    "nodes": [{"id": "N_A", "duality": "L:P:CS_A", "x": 1.0, "y": 1.0}, {"id": "N_B", "duality": "L:P:CS_B", "x": 3.0, "y": 1.0}],
    "edges": [{"id": "E_1", "weight": 1.0, "connects": ["L:D:N_A", "L:D:N_B"], "traversable": True}],
}
LEGACY = {
    "configuracion": {"ancho": 10, "alto": 5},
    "espacios_navegables": {"Sala 1": {"centroide": [1, 2], "poligono": [[0, 0], [2, 0], [2, 4], [0, 4]], "atributos": {"tipo": "room"}}, "Puerta 1": {"centroide": [2, 2], "poligono": [], "atributos": {}}},
    "muros": [{"id": "M1", "tipo": "muro_exterior", "poligono": []}, {"id": "V1", "tipo": "ventana", "poligono": []}],
    "conexiones_horizontales": [{"origen": "Sala 1", "destino": "Puerta 1", "tipo": "room_door", "contexto": None}],
    "conexiones_verticales": [{"nodo_id": "Escalera", "capa_superior": "micro", "capa_inferior": "meso", "tipo_conexion": "stairs"}],
    "agentesspawn": [[1, 1]],
}


def write(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_model_round_trip(spark, tmp_path):
    m = documents.models(spark, write(tmp_path / "m.json", MODEL))
    assert documents.cells(m).count() == 2 and documents.boundaries(m).first().cells == ["CS_A", "CS_B"]
    cross = {r.cell: (r.node, r.boundaries, r.edges) for r in documents.cross_maps(m).collect()}
    assert cross == {"CS_A": ("N_A", ["CB_1"], ["E_1"]), "CS_B": ("N_B", ["CB_1"], ["E_1"])}
    raw = documents.models(spark, str(tmp_path / "m.json"))
    text = sinks.model_json(*(raw.select(F.inline(c)) for c in ("cells", "boundaries", "nodes", "edges")), "two rooms").first().value
    back = json.loads(text)
    assert back["modelName"] == "two rooms" and back["edges"] == MODEL["edges"] and back["cells"][1] == MODEL["cells"][1]


def test_root_must_be_an_object(spark, tmp_path):
    assert documents.models(spark, write(tmp_path / "x.json", "just text")).first()._corrupt_record is not None


def test_latest_file(spark, tmp_path):
    import os

    for i, n in enumerate("abc"):
        write(tmp_path / f"{n}.json", {})
        os.utime(tmp_path / f"{n}.json", (1000 + i % 2, 1000 + i % 2))
    assert documents.latest_file(spark, str(tmp_path)).endswith("b.json")


def test_legacy_map(spark, tmp_path):
    m = documents.legacy_map(spark, write(tmp_path / "v1.json", LEGACY))
    assert {(r.name, r.x) for r in documents.legacy_spaces(m).collect()} == {("Sala 1", 1.0), ("Puerta 1", 2.0)}
    assert [r.id for r in documents.legacy_walls(m).collect()] == ["M1"]
    assert {(r.origen, r.destino, r.vertical) for r in documents.legacy_links(m).collect()} == {("Sala 1", "Puerta 1", False), ("meso", "micro", True)}
    back = json.loads(sinks.legacy_json(documents.legacy_spaces(m), documents.legacy_links(m)).first().value)
    assert back["espacios_navegables"]["Sala 1"]["centroide"] == [1.0, 2.0] and "contexto" not in back["conexiones_horizontales"][0]


def test_event_log_and_months(spark, tmp_path):
    log = spark.createDataFrame([(1, "7", "RECALCULO", "x", 0.0, 1.0), (2, "SYSTEM", "FUEGO_CREADO", None, 1.0, 1.0)], "Step int, AgenteID string, Evento string, Valor string, Pos_X double, Pos_Y double")
    for _ in range(2):
        sinks.event_log(log, str(tmp_path / "log"))
    assert documents.event_log(spark, str(tmp_path / "log")).count() == 4
    times = spark.createDataFrame([("2024-01-31",), ("2024-02-01",)], "d string").select(F.col("d").cast("timestamp").alias("ts"))
    sinks.monthly(times, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).where("month = 2").count() == 1


def test_uplinks(spark):
    message = {"name": "S-101", "time": "2024-01-01T00:00:00Z", "data": {"end_device_ids": {"device_id": "d1"}, "received_at": "2024-01-01T00:00:05Z", "uplink_message": {"decoded_payload": {"co2": {"value": 5600, "unit": "ppm"}, "tvoc": {"value": 1250, "unit": "ppb"}}}}}
    raw = spark.createDataFrame([(json.dumps(message),), ("not json",)], "value string")
    assert {(r.sensor, r.room, r.variable, r.value) for r in documents.uplinks(spark, raw).collect()} == {("d1", "S-101", "co2", 5600.0), ("d1", "S-101", "tvoc", 1250.0)}
    assert raw.select(documents.payload_value(F.col("value"), "co2").alias("v")).first().v == 5600.0
    line = raw.limit(1).select(sinks.line_protocol(F.lit("air"), F.lit("S 101"), F.lit("co2"), F.lit(1.5), F.lit("2024-01-01").cast("timestamp")).alias("l")).first().l
    assert line == "air,room=S\\ 101,variable=co2 value=1.5 1704067200000000000"


def test_sample_cells_and_keys(spark):
    c = documents.sample_cells(spark)
    assert c.count() == 123 and {(r.level, r["count"]) for r in c.groupBy("level").count().collect()} == {("P00", 81), ("P01", 23), ("P02", 19)}
    assert spark.range(1).select(documents.reference_keys(F.lit("CS_1"), F.lit("L"), F.lit("C")).alias("k")).first().k == ["CS_1", "L:C:CS_1"]
