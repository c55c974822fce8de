"""Reading and flattening of maps, indoor models, event logs and sensor messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.ids import tail

CELL = "id string, level string, cellSpaceName string, duality string, navigationType string, navigationClass string, category string, function string, boundedBy array<string>, locomotionTypes array<string>, rings array<array<struct<x:double,y:double>>>, attributes map<string,string>"
BOUNDARY = "id string, isVirtual boolean, duality string, traversable boolean, cellRefs array<string>, line array<struct<x:double,y:double>>, attributes map<string,string>"
NODE = "id string, duality string, x double, y double, connects array<string>"
EDGE = "id string, duality string, weight double, connects array<string>, traversable boolean, relationshipType string, transferSpaceRef string, locomotionTypes array<string>"


def model_schema() -> StructType:
    """Documents as one nested row: levels, and the members of the primal and dual layers."""
    part = lambda ddl: "array<struct<" + ddl_to_struct(ddl) + ">>"
    return StructType.fromDDL(f"modelName string, levels array<struct<id:string,`order`:int,floorZ:double>>, cells {part(CELL)}, boundaries {part(BOUNDARY)}, nodes {part(NODE)}, edges {part(EDGE)}, layerConnections array<struct<id:string,connectedNodes:array<string>,connectedCells:array<string>>>, sourceFeatures array<struct<id:string,sourceType:string,level:string,attributes:map<string,string>>>, _corrupt_record string")


def ddl_to_struct(ddl: str) -> str:
    """Column list to struct fields: the first blank of each top-level item becomes a colon."""
    out, depth, item = [], 0, ""
    for ch in ddl + ",":
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            name, kind = item.strip().split(" ", 1)
            out.append(f"`{name}`:{kind}")
            item = ""
        else:
            item += ch
    return ",".join(out)


def legacy_map(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Map documents as one row each, a file a document, or a line with ``lines``; a missing path raises."""
    return spark.read.schema(schemas.LEGACY_MAP).json(path, multiLine=not lines)


def legacy_spaces(maps: DataFrame) -> DataFrame:
    return maps.select(F.explode("espacios_navegables").alias("name", "s")).select("name", F.get("s.centroide", F.lit(0)).alias("x"), F.get("s.centroide", F.lit(1)).alias("y"), "s.poligono", "s.atributos")


def legacy_walls(maps: DataFrame) -> DataFrame:
    """Walls only: other types collide with nothing."""
    return maps.select(F.inline("muros")).where("tipo in ('muro_exterior', 'muro_interior')")


def legacy_links(maps: DataFrame) -> DataFrame:
    """(origen, destino, tipo, contexto, vertical): horizontal and vertical links together."""
    flat = maps.select(F.inline("conexiones_horizontales")).select("origen", "destino", "tipo", "contexto", F.lit(False).alias("vertical"))
    up = maps.select(F.inline("conexiones_verticales")).select(F.col("capa_inferior").alias("origen"), F.col("capa_superior").alias("destino"), F.col("tipo_conexion").alias("tipo"), F.col("nodo_id").alias("contexto"), F.lit(True).alias("vertical"))
    return flat.unionByName(up)


def models(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Indoor models, one row a document, a file each, or a line each with ``lines``; a root that is no object has all in _corrupt_record."""
    return spark.read.schema(model_schema()).json(path, multiLine=not lines, mode="PERMISSIVE")


def source_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The source features of model documents, one row each, as ``reexport`` takes them; a document without any gives no row.

    A line's coordinates are its points, an area's those of its outer ring.
    """
    kind = "id string, metadata struct<name:string>, sourceFeatures array<struct<id:string,level:string,sourceType:string,geometry:string,attributes:map<string,string>>>"
    docs = spark.read.schema(kind).json(path, multiLine=not lines).select(F.coalesce("metadata.name", "id", F.lit("model")).alias("model"), F.inline("sourceFeatures").alias("id", "level", "sourceType", "g", "attributes"))
    type_, text = F.get_json_object("g", "$.type"), F.get_json_object("g", "$.coordinates")
    points = F.when(type_ == "Polygon", F.get(F.from_json(text, "array<array<array<double>>>"), F.lit(0))).otherwise(F.from_json(text, "array<array<double>>"))
    return docs.select("model", "id", "level", "sourceType", F.struct(type_.alias("type"), points.alias("coordinates")).alias("geometry"), F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"))


def latest_file(spark: SparkSession, folder: str, glob: str = "*.json") -> str | None:
    """The newest file of a folder by modification time, the greater path at equal times."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "modificationTime")
    newest = files.agg(F.max(F.struct("modificationTime", "path")).alias("m")).first()
    return newest["m"]["path"] if newest["m"] else None


def cells(m: DataFrame) -> DataFrame:
    return m.select(F.inline("cells"))


def boundaries(m: DataFrame) -> DataFrame:
    return m.select(F.inline("boundaries")).withColumn("cells", F.transform("cellRefs", tail))


def nodes(m: DataFrame) -> DataFrame:
    return m.select(F.inline("nodes")).withColumn("cell", tail(F.col("duality")))


def edges(m: DataFrame) -> DataFrame:
    e = m.select(F.inline("edges")).withColumn("ends", F.transform("connects", tail))
    return e.withColumn("u", F.get("ends", F.lit(0))).withColumn("v", F.get("ends", F.lit(1)))


def cross_maps(m: DataFrame) -> DataFrame:
    """(cell, node, boundaries, edges): what belongs to each cell. Joined by shuffle: documents hold many rows each, of which Spark's estimate knows nothing."""
    n = nodes(m).select("cell", F.col("id").alias("node"))
    b = boundaries(m).select(F.explode("cells").alias("cell"), "id").groupBy("cell").agg(F.sort_array(F.collect_set("id")).alias("boundaries"))
    e = edges(m).select(F.explode("ends").alias("node"), "id").groupBy("node").agg(F.sort_array(F.collect_set("id")).alias("edges"))
    return cells(m).select(F.col("id").alias("cell")).join(n.hint("merge"), "cell", "left").join(b.hint("merge"), "cell", "left").join(e.hint("merge"), "node", "left").select("cell", "node", "boundaries", "edges")


def reference_keys(id_: Column, layer: Column, container: Column) -> Column:
    """All forms an id is referred to by: itself, its last segment, fully qualified."""
    return F.array_distinct(F.array(id_, tail(id_), F.concat_ws(":", layer, container, id_)))


def event_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schemas.EVENT_LOG)


def uplinks(spark: SparkSession, raw: DataFrame, column: str = "value") -> DataFrame:
    """(sensor, room, ts, variable, value, unit) of JSON messages; a message that does not parse gives no row."""
    m = raw.select(F.from_json(F.col(column).cast("string"), schemas.UPLINK).alias("m")).where("m is not null")
    one = m.select(F.col("m.data.end_device_ids.device_id").alias("sensor"), F.col("m.name").alias("room"), F.coalesce("m.data.received_at", "m.time").alias("ts"), F.explode("m.data.uplink_message.decoded_payload").alias("variable", "p"))
    return one.select("sensor", "room", "ts", "variable", "p.value", "p.unit")


def payload_value(raw: Column, variable: str) -> Column:
    """One variable of a message, by path."""
    return F.get_json_object(raw, f"$.data.uplink_message.decoded_payload.{variable}.value").cast("double")


def sample_cells(spark: SparkSession, per_level: dict[str, int] | None = None) -> DataFrame:
    """Rectangular sample cells by level, 123 in all by default, ten metres apart."""
    counts = per_level or {"P00": 81, "P01": 23, "P02": 19}
    rows = [(level, n) for level, n in counts.items()]
    each = spark.createDataFrame(rows, "level string, n int").select("level", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    x, y = (F.col("k") % 9 * 10).cast("double"), (F.floor(F.col("k") / 9) * 10).cast("double")
    return each.select(F.concat(F.lit("CS-"), F.substr("level", F.lit(2)), F.lpad(F.col("k").cast("string"), 3, "0")).alias("cell_id"), "level", x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 10).alias("y1"))
