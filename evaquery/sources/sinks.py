"""Writing of logs, summaries, models and readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_log(df: DataFrame, path: str, mode: str = "append") -> None:
    """Event log as CSV with its header in every part, so parts read alone."""
    df.select("Step", "AgenteID", "Evento", "Valor", "Pos_X", "Pos_Y").write.mode(mode).option("header", True).csv(path)


def summary(df: DataFrame, path: str) -> None:
    """Run summaries, appended; each append is one commit."""
    df.write.mode("append").option("header", True).csv(path)


def results(df: DataFrame, path: str, *by: str) -> None:
    """A run's result table (trajectories, readings, weights over time), partitioned for pruning."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def monthly(df: DataFrame, path: str, ts: str = "ts") -> None:
    """History by year and month."""
    df.withColumn("year", F.year(ts)).withColumn("month", F.month(ts)).write.mode("append").partitionBy("year", "month").parquet(path)


def model_json(cells: DataFrame, boundaries: DataFrame, nodes: DataFrame, edges: DataFrame, name: str | None = None, by: str | None = None) -> DataFrame:
    """(value), a row a document: models as JSON without nulls; all rows are of the one model ``name``, or of the models that column ``by`` names."""
    from ..plans.reexport import snapshot

    parts = {"cells": cells, "boundaries": boundaries, "nodes": nodes, "edges": edges}
    if by is None:
        by, parts = "__model", {k: v.withColumn("__model", F.lit(name)) for k, v in parts.items()}
    made = snapshot(by, **parts)
    head = F.concat(F.lit('{"modelName":'), F.to_json(F.struct(F.col("model").alias("m"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("model").alias("m")))) - 6), F.lit(","))
    out = made.select("model", F.concat(head, F.substr("value", F.lit(2))).alias("value"))
    return out.select("value") if by == "__model" else out


def legacy_json(spaces: DataFrame, links: DataFrame, walls: DataFrame | None = None, spawns: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """(value), a row a map: spaces by name, horizontal and vertical links, walls and spawn points, as JSON without nulls.

    All rows are of one map, or of the maps that column ``by`` names.
    """
    key = by or "__map"
    own = lambda df: df if by else df.withColumn(key, F.lit(0))
    s = own(spaces).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct(F.array("x", "y").alias("centroide"), F.col("poligono"), F.col("atributos"))))).alias("espacios_navegables"))
    listed = lambda df, out, *cols: own(df).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(out))
    parts = [listed(links.where("not vertical"), "conexiones_horizontales", "origen", "destino", "tipo", "contexto")]
    parts.append(listed(links.where("vertical"), "conexiones_verticales", F.col("contexto").alias("nodo_id"), F.col("destino").alias("capa_superior"), F.col("origen").alias("capa_inferior"), F.col("tipo").alias("tipo_conexion")))
    if walls is not None:
        parts.append(listed(walls, "muros", "id", "tipo", "poligono"))
    if spawns is not None:
        parts.append(own(spawns).groupBy(key).agg(F.array_sort(F.collect_list(F.array("x", "y"))).alias("agentesspawn")))
    out = s
    for p in parts:
        out = out.join(p, key, "left")
    members = [c for c in out.columns if c != key]
    value = F.to_json(F.struct(*members), {"ignoreNullFields": "true"}).alias("value")
    return out.select(key, value) if by else out.select(value)


def line_protocol(measurement: Column, room: Column, variable: Column, value: Column, ts: Column) -> Column:
    """One reading in line protocol, blanks and commas of tags escaped, time in nanoseconds."""
    tag = lambda c: F.regexp_replace(c, "([ ,=])", r"\\$1")
    return F.concat(measurement, F.lit(",room="), tag(room), F.lit(",variable="), tag(variable), F.lit(" value="), value.cast("string"), F.lit(" "), (F.unix_micros(ts) * 1000).cast("string"))
