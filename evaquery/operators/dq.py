"""Data-quality rules as violation queries: (rule, key) rows, none where the rule holds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import tasks

#: Rows of a table whose keys one task holds; more are counted and dealt by key, as a few dozen compressed megabytes of keys are gigabytes in a task.
KEY_ROWS = 200_000


def breach(df: DataFrame, rule: str, key: Column | str, wrong: Column) -> DataFrame:
    """Rows for which ``wrong`` holds; null is not wrong."""
    own = F.col(key) if isinstance(key, str) else key
    return df.where(wrong).select(F.lit(rule).alias("rule"), own.cast("string").alias("key"))


def repeated(df: DataFrame, rule: str, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return many.select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"))


def dangling(df: DataFrame, rule: str, column: str, target: DataFrame, target_column: str) -> DataFrame:
    """References without a target; null refers to nothing."""
    lost = df.where(F.col(column).isNotNull()).join(target.select(F.col(target_column).alias(column)).distinct(), column, "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("key")).distinct()


def foreign_keys(tables: dict[str, DataFrame], keys: Iterable[tuple[str, str, str, str]]) -> DataFrame:
    """(rule, key): references (table, column, target table, target column) that lead nowhere.

    Two tables that are both of many rows are dealt by key before they meet.
    """
    keys = list(keys)
    n = {t: tasks(tables[t], KEY_ROWS) for t in {t for key in keys for t in (key[0], key[2])}}

    def own(t: str, column: str, other: str) -> DataFrame:
        return tables[t].repartition(max(n[t], n[other]), column) if min(n[t], n[other]) > 1 else tables[t]

    return report(dangling(own(t, c, target), f"{t}.{c}", c, own(target, tc, t), tc) for t, c, target, tc in keys)


def unique_keys(tables: dict[str, DataFrame], keys: Iterable[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """(rule, key): values that occur twice where (table, columns) says once; rows with a null among them are free. Many rows are dealt by key."""
    keys = list(keys)
    n = {t: tasks(tables[t], KEY_ROWS) for t in {t for t, _ in keys}}
    dealt = lambda t, cs: tables[t].repartition(n[t], *cs) if n[t] > 1 else tables[t]
    known = lambda t, cs: dealt(t, cs).where(" and ".join(f"{c} is not null" for c in cs))
    return report(repeated(known(t, cs), f"{t}({', '.join(cs)})", *cs) for t, cs in keys)


def same_theme(duals: DataFrame, primals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (id_dual, id_primal) that no theme joins; ids that do not exist included."""
    ok = duals.join(primals, "id_theme_layer").select("id_dual", "id_primal")
    return pairs.select("id_dual", "id_primal").distinct().join(ok, ["id_dual", "id_primal"], "left_anti")


def nodes_outside(nodes: DataFrame, cells: DataFrame, duals: DataFrame) -> DataFrame:
    """Placed nodes (id_node, id_dual, id_cell, x, y) of duals that are not logical, whose cell (id_cell, x0, y0, x1, y1) does not cover them."""
    real = nodes.where("x is not null and y is not null").join(duals.where("not is_logical").select("id_dual"), "id_dual", "left_semi")
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    return real.join(cells.select("id_cell", "x0", "y0", "x1", "y1"), "id_cell", "left").where(~F.coalesce(inside, F.lit(False))).select("id_node", "id_cell")


def warnings_by_cell(overlaps: DataFrame, most: int = 20) -> DataFrame:
    """(cell, other, area): overlaps (a, b, area) told to each of the two cells, the ``most`` largest of a cell, as its report lists them."""
    from pyspark.sql import Window

    both = overlaps.select(F.col("a").alias("cell"), F.col("b").alias("other"), "area").unionByName(overlaps.select(F.col("b").alias("cell"), F.col("a").alias("other"), "area"))
    return both.withColumn("rn", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("area"), "other"))).where(F.col("rn") <= most).drop("rn")


def first_errors(errors: DataFrame, most: int) -> DataFrame:
    """The first errors by path, then message: the listing of a validation report."""
    return errors.orderBy("path", "message").limit(most)


def report(parts: Iterable[DataFrame]) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def ring_faults(rings: Column) -> Column:
    """Names what is wrong with a closed ring; null for a sound one."""
    from ..functions.geometry import ring_area

    first, last = F.get(rings, F.lit(0)), F.element_at(rings, -1)
    return F.when(F.size(rings) < 4, "too few points").when((first["x"] != last["x"]) | (first["y"] != last["y"]), "open").when(ring_area(rings) == 0, "no area")


def coherent_navigation(spaces: DataFrame, functions: DataFrame) -> DataFrame:
    """Kind from the catalogue; transfers take their function's locomotion, general spaces none; unknown codes flagged."""
    f = functions.select(F.col("code").alias("function_code"), F.col("kind").alias("k"), "default_locomotion")
    both = spaces.join(F.broadcast(f), "function_code", "left")  # the catalogue is a constant of the schema
    own = F.when(F.col("k") == "TRANSFER", F.coalesce("locomotion", "default_locomotion"))
    return both.select("cell_id", F.col("k").alias("kind"), own.alias("locomotion"), F.col("k").isNull().alias("unknown_code"))


def chain_faults(tiles: DataFrame) -> DataFrame:
    """(chain, pos, fault) of tile chains (chain, pos, x, y): repeated tiles, steps to no neighbour."""
    from pyspark.sql import Window

    by = Window.partitionBy("chain").orderBy("pos")
    step = F.abs(F.col("x") - F.lag("x").over(by)) + F.abs(F.col("y") - F.lag("y").over(by))
    seen = F.count(F.lit(1)).over(Window.partitionBy("chain", "x", "y"))
    return tiles.select("chain", "pos", F.when(seen > 1, "repeated").when(step != 1, "gap").alias("fault")).where("fault is not null")


def opening_faults(cells: DataFrame, bounds: DataFrame, least: float = 0.05) -> DataFrame:
    """(rule, key): doors that do not lead from one space to one other, windows that belong to none."""
    touch = bounds.where(F.col("length") >= least) if "length" in bounds.columns else bounds
    sides = touch.select(F.col("a").alias("via"), F.col("b").alias("cell")).union(touch.select(F.col("b").alias("via"), F.col("a").alias("cell")))
    spaces = cells.where("navigation_type = 'GeneralSpace'").select("cell")
    n = sides.join(spaces, "cell", "left_semi").groupBy("via").agg(F.countDistinct("cell").alias("n"))
    own = cells.where("category in ('Door', 'Window')").join(n, F.col("cell") == F.col("via"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return breach(own, "door without two spaces", "cell", (F.col("category") == "Door") & (F.col("n") != 2)).unionByName(breach(own, "window without a space", "cell", (F.col("category") == "Window") & (F.col("n") < 1)))


def schema_errors(documents: DataFrame, key: str, text: str, schema: dict, most: int | None = None) -> DataFrame:
    """(key, n, path, message): what breaks a JSON schema in each document, by path; the first ``most`` of a document where a report asks for so many.

    Documents are independent and each is read whole, in Arrow batches.
    """
    import pandas as pd

    from ..functions.schemas import validated

    def run(batches):
        for rows in batches:
            out = [(k, i, *e) for k, t in zip(rows[key], rows[text]) for i, e in enumerate(validated(t, schema)[:most])]
            yield pd.DataFrame(out, columns=[key, "n", "path", "message"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInPandas(run, f"{key} {kind}, n long, path string, message string")
