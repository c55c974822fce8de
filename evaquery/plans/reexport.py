"""From the source features of a model document back to authored features, and to a model built anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import builder

#: Source types of a document's line features, and the line type each is authored as.
SOURCE_LINES = {"wall_centerline": "muro_interior", "door_centerline": "puerta_simple", "exit_centerline": "salida", "window_centerline": "ventana", "virtual_boundary_line": "frontera_virtual"}
AREA = "room_polygon"
SOURCE = "model string, id string, level string, sourceType string, geometry struct<type:string,coordinates:array<array<double>>>, attributes map<string,string>"


def _source_type(kind: Column) -> Column:
    line = F.when(kind.isin(*builder.WALLS), "wall_centerline").when(kind.isin("puerta_simple", "puerta_doble"), "door_centerline").when(kind == "salida", "exit_centerline")
    return line.when(kind.isin("ventana", "ventana_practicable"), "window_centerline").when(kind == "frontera_virtual", "virtual_boundary_line").otherwise(AREA)


def sources(features: DataFrame) -> DataFrame:
    """Authored features (with a column model) as the source features that a document keeps: ids, GeoJSON geometry, attributes without nulls."""
    kind = F.col("kind")
    closed = F.when(F.col("sourceType") == AREA, F.concat("ring", F.slice("ring", 1, 1))).otherwise(F.col("ring"))
    given = F.create_map(F.lit("originalType"), kind, F.lit("originalName"), F.col("name"), F.lit("thicknessM"), F.col("thickness").cast("string"), F.lit("widthM"), F.col("width").cast("string"), F.lit("host"), F.col("host"))
    typed = builder.source_features(features).withColumn("sourceType", _source_type(kind))
    shape = F.struct(F.when(F.col("sourceType") == AREA, "Polygon").otherwise("LineString").alias("type"), closed.alias("coordinates"))
    return typed.select("model", F.col("feature").alias("id"), "level", "sourceType", shape.alias("geometry"), F.map_filter(given, lambda _, v: v.isNotNull()).alias("attributes"))


def features(sources_: DataFrame) -> DataFrame:
    """Source features as authored ones: type and name as they were, or those of the source type and the id.

    Closed rings lose their last point. Lines of under two points, areas of under three
    and features of unknown source types are left out, as nothing can be drawn of them.
    """
    known = F.create_map(*[F.lit(x) for pair in SOURCE_LINES.items() for x in pair])
    area = F.col("sourceType") == AREA
    points = F.col("geometry.coordinates")
    open_ = F.when(area & (F.size(points) > 1) & (F.element_at(points, 1) == F.element_at(points, -1)), F.slice(points, F.lit(1), F.size(points) - 1)).otherwise(points)
    own = sources_.withColumn("ring", open_)
    drawn = F.when(area, (F.col("geometry.type") == "Polygon") & (F.size("ring") >= 3)).otherwise(F.col("sourceType").isin(*SOURCE_LINES) & (F.col("geometry.type") == "LineString") & (F.size("ring") >= 2))
    at = lambda name: F.col("attributes")[name]
    line = F.when(area, F.col("ring")).otherwise(F.array(F.element_at("ring", 1), F.element_at("ring", -1)))
    return own.where(drawn).select(
        "model", "level", F.coalesce(at("originalType"), known[F.col("sourceType")], F.lit("space")).alias("kind"), F.coalesce(at("originalName"), F.col("id")).alias("name"), line.alias("ring"),
        at("thicknessM").cast("double").alias("thickness"), at("widthM").cast("double").alias("width"), at("host").alias("host"),
    )


def canvas(sources_: DataFrame) -> DataFrame:
    """(model, width, height): the greatest coordinates of a model's sources; zero for one without any."""
    most = lambda k: F.array_max(F.transform("geometry.coordinates", lambda p: F.get(p, F.lit(k))))
    return sources_.groupBy("model").agg(F.coalesce(F.max(most(0)), F.lit(0.0)).alias("width"), F.coalesce(F.max(most(1)), F.lit(0.0)).alias("height"))


def rebuilt(sources_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, boundaries) of the models that the sources describe."""
    own = features(sources_)
    cells = builder.cells(own)
    return cells, builder.boundaries(cells, builder.contacts(cells, own))


def level_rows(levels: DataFrame) -> DataFrame:
    """Levels (model, index, id, name, order, height, elevation, floor) with what they lack: ids and names by their place, elevation by floor or height."""
    height = F.coalesce("height", F.lit(3.0))
    id_ = F.coalesce("id", F.concat(F.lit("LEVEL_"), F.lpad(F.col("index").cast("string"), 2, "0")))
    return levels.select("model", id_.alias("id"), F.coalesce("name", id_).alias("name"), F.coalesce("order", "index").alias("order"), F.coalesce("elevation", "floor", F.col("index") * height).alias("elevation"), height.alias("height"))


def snapshot(model_col: str, **collections: DataFrame) -> DataFrame:
    """(model, value): every collection of a model as JSON, by name, its rows in order of their text, nulls left out."""
    out = None
    for name, rows in sorted(collections.items()):
        text = F.to_json(F.struct(*[c for c in rows.columns if c != model_col]), {"ignoreNullFields": "true"})
        own = rows.select(F.col(model_col).alias("model"), F.lit(name).alias("collection"), text.alias("row"))
        out = own if out is None else out.unionByName(own)
    listed = out.groupBy("model", "collection").agg(F.array_join(F.array_sort(F.collect_list("row")), ",").alias("rows"))
    member = F.concat(F.lit('"'), F.col("collection"), F.lit('":['), F.col("rows"), F.lit("]"))
    return listed.groupBy("model").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(member)), ","), F.lit("}")).alias("value"))
