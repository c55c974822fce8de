"""Enumerations, the navigation-function catalogue and the schemas of documents and streams."""

from __future__ import annotations

#: The references and unique keys of the indoor database.
FOREIGN_KEYS = (
    ("primal_space_layer", "id_theme_layer", "theme_layer", "id_theme"), ("dual_space_layer", "id_theme_layer", "theme_layer", "id_theme"),
    ("cell_space", "id_primal_space_layer", "primal_space_layer", "id_primal"), ("cell_boundary", "id_primal_space_layer", "primal_space_layer", "id_primal"),
    ("cellspace_cellboundary", "id_cell_space", "cell_space", "id_cell_space"), ("cellspace_cellboundary", "id_cell_boundary", "cell_boundary", "id_cell_boundary"),
    ("node", "id_dual", "dual_space_layer", "id_dual"), ("node", "id_cell_space", "cell_space", "id_cell_space"),
    ("edge", "id_dual", "dual_space_layer", "id_dual"), ("edge", "id_cell_boundary", "cell_boundary", "id_cell_boundary"), ("edge", "from_node", "node", "id_node"), ("edge", "to_node", "node", "id_node"),
    ("navigable_space", "id_cell_space", "cell_space", "id_cell_space"), ("navigable_space", "function_code", "nav_space_function", "code"),
)
UNIQUE_KEYS = (
    ("primal_space_layer", ("id_theme_layer",)), ("dual_space_layer", ("id_theme_layer",)), ("cellspace_cellboundary", ("id_cell_space", "id_cell_boundary")),
    ("node", ("id_dual", "id_cell_space")), ("edge", ("id_dual", "id_cell_boundary")), ("edge", ("id_dual", "low_node", "high_node")), ("cell_boundary", ("boundary_key",)),
)

from pyspark.sql import DataFrame, SparkSession

#: Code, label, kind and default locomotion of the navigation functions.
NAVIGATION_FUNCTIONS = [
    ("SPACE", "Space", "GENERAL", "WALK"),
    ("ADMIN", "Administration", "GENERAL", "WALK"),
    ("STORAGE", "Storage", "GENERAL", "WALK"),
    ("OFFICE", "Office", "GENERAL", "WALK"),
    ("CORRIDOR", "Corridor", "GENERAL", "WALK"),
    ("HALL", "Hall", "GENERAL", "WALK"),
    ("STAIRS", "Stair", "TRANSFER", "STAIRS"),
    ("ELEVATOR", "Elevator", "TRANSFER", "ELEVATOR"),
    ("ESCALATOR", "Escalator", "TRANSFER", "ESCALATOR"),
    ("RAMP", "Ramp", "TRANSFER", "RAMP"),
    ("LOBBY", "Transfer Lobby", "TRANSFER", "WALK"),
    ("DOOR", "Door", "TRANSFER", "WALK"),
    ("WINDOW", "Window", "TRANSFER", "JUMP"),
]
KINDS = ("GENERAL", "TRANSFER")
LOCOMOTIONS = ("WALK", "STAIRS", "ELEVATOR", "ESCALATOR", "RAMP", "JUMP", "OTHER")
EVENT_TYPES = ("FUEGO_CREADO", "RECALCULO", "CAMBIO_RUTA", "EVACUACION_COMPLETA")

POINT = "struct<x:double,y:double>"
EVENT_LOG = "Step int, AgenteID string, Evento string, Valor string, Pos_X double, Pos_Y double"
LEGACY_MAP = (
    "configuracion struct<ancho:double,alto:double>, "
    "espacios_navegables map<string,struct<centroide:array<double>,poligono:array<array<double>>,atributos:map<string,string>>>, "
    "muros array<struct<id:string,tipo:string,poligono:array<array<double>>>>, "
    "conexiones_horizontales array<struct<origen:string,destino:string,tipo:string,contexto:string>>, "
    "conexiones_verticales array<struct<nodo_id:string,capa_superior:string,capa_inferior:string,tipo_conexion:string>>, "
    "agentesspawn array<array<double>>"
)
READING = "room string, sensor string, variable string, ts timestamp, value double"
UPLINK = (
    "name string, time timestamp, data struct<end_device_ids:struct<device_id:string>,received_at:timestamp,"
    "uplink_message:struct<f_port:int,f_cnt:int,frm_payload:string,decoded_payload:map<string,struct<displayName:string,value:double,unit:string>>>>"
)


def navigation_functions(spark: SparkSession) -> DataFrame:
    """The seed catalogue; loading it again adds nothing, codes being unique."""
    return spark.createDataFrame(NAVIGATION_FUNCTIONS, "code string, label string, kind string, default_locomotion string").dropDuplicates(["code"])
