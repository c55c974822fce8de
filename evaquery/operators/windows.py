"""Ordered operators: latest rows, running values, changes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored


def latest(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The last row of each key, the greatest ``tie`` at equal times: an aggregate, so hot keys reduce before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(ts, tie, *[c for c in rest if c not in (ts, tie)])).alias("b"))
    return best.select(*keys, *[F.col("b")[c].alias(c) for c in rest])


def mean_of_last(df: DataFrame, keys: list[str], ts: str, tie: str, value: str, n: int = 3) -> DataFrame:
    """(keys, mean, rows_used) of the last ``n`` rows of a key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(ts), F.desc(tie))
    last = df.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
    return last.groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), F.count(F.lit(1)).alias("rows_used"))


def _averaged(df: DataFrame, key: str, order: list[str], value: str, alpha: float) -> DataFrame:
    """(key, *order, value, part, at, first, n, mean): moving averages within a range of rows in order of (key, *order).

    Rows are dealt by key and order together, so a key that holds most of them is spread over
    many tasks. An average starts from nought at a range's start and at a key's; n counts
    the rows of the key in the range up to the row, first is the value that the key begins
    with there, and ``at`` says whether the key is the first one of its range.
    """
    rows = df.select(key, *order, value).repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None  # key, mean, n, first value, whether it is the range's first key
        for batch in batches:
            if batch.empty:
                continue
            codes = pd.factorize(batch[key], use_na_sentinel=False)[0]
            group = np.cumsum(np.append(True, codes[1:] != codes[:-1])) - 1
            x = batch[value].astype(float)
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            same = last is not None and (last[0] == batch[key].iloc[0] or (pd.isna(last[0]) and pd.isna(batch[key].iloc[0])))
            lead = pd.Series(np.zeros(len(starts)))
            seen, first = np.zeros(len(starts), dtype=np.int64), x.to_numpy()[starts].copy()
            if same:
                lead[0], seen[0], first[0] = last[1], last[2], last[3]
            # a row of its own before each key's rows, so that the recurrence starts from there
            place = np.concatenate([starts - 0.5, np.arange(len(x))])
            turn = np.argsort(place, kind="stable")
            both = pd.Series(np.concatenate([lead, x])[turn]).groupby(np.concatenate([np.arange(len(starts)), group])[turn]).ewm(alpha=alpha, adjust=False).mean().to_numpy()
            mean = both[turn >= len(starts)]
            n = np.arange(len(x)) - starts[group] + 1 + seen[group]
            leads = group == 0 if last is None or (same and last[4]) else np.zeros(len(x), dtype=bool)
            last = (batch[key].iloc[-1], mean[-1], int(n[-1]), float(first[group[-1]]), bool(leads[-1]))
            yield batch.assign(at=leads, first=first[group], n=n, mean=mean)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *order, value))
    return rows.mapInPandas(run, f"{ddl}, part int, at boolean, first double, n long, mean double")


def _carried(ends: DataFrame, key: str, alpha: float, start: float | None) -> DataFrame:
    """(key, part, n, before, mean): the ends (key, part, n, first, mean) of each key's ranges with the average before
    them and the one behind. A range is an affine map of the average before it, and maps are composed in order."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, mean = None, 0.0
        for batch in batches:
            befores, means = [], []
            for k, n, first, own in zip(batch[key].tolist(), batch["n"].tolist(), batch["first"].tolist(), batch["mean"].tolist()):
                k = None if pd.isna(k) else k
                before = mean if at == (k,) else first if start is None else start
                at, mean = (k,), own + (1 - alpha) ** n * before
                befores.append(before)
                means.append(mean)
            yield pd.DataFrame({key: batch[key], "part": batch["part"], "n": batch["n"], "before": befores, "mean": means})

    kind = ends.schema[key].dataType.simpleString()
    return ends.select(key, "part", "n", "first", "mean").repartition(key).sortWithinPartitions(key, "part").mapInPandas(run, f"`{key}` {kind}, part int, n long, before double, mean double")


def _ends(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each key in each range."""
    return rows.groupBy(key, "part").agg(F.max(F.struct("n", "first", "mean", "at")).alias("e")).select(key, "part", "e.*")


def ema(df: DataFrame, key: str, ts: str, value: str, alpha: float = 0.3, first: float = 1.0) -> DataFrame:
    """(key, ema, n): exponential moving average over a key's rows in order of time, from ``first`` on.

    Ranges of rows are averaged apart and their ends composed, so no task holds a series and
    a key of any size is spread over all tasks. Equal times go by value; null values count
    as no row.
    """
    own = stored(df.where(F.col(value).isNotNull()).select(key, ts, F.col(value).cast("double").alias(value)))
    carried = _carried(_ends(_averaged(own.withColumn("__x", F.col(value)), key, [ts, "__x"], value, alpha), key), key, alpha, first)
    last = carried.groupBy(key).agg(F.max(F.struct("part", "mean")).alias("e"), F.sum("n").alias("n"))
    return last.select(key, F.round("e.mean", 6).alias("ema"), "n")


def smoothed(df: DataFrame, key: str, order: str, value: str, alpha: float) -> DataFrame:
    """The rows (key, order, value), each value the moving average up to it, from the key's first value on.

    Ranges of rows are averaged apart (see ``_averaged``). Only the first key of a range can
    have begun in one before, so one row a range says what its rows still need: what is
    broadcast grows with the ranges, not with rows or keys.
    """
    rows = stored(_averaged(df, key, [order], value, alpha))
    ends = stored(_ends(rows, key))
    before = _carried(ends, key, alpha, None).select("part", F.col(key).alias("__key"), "before")
    lead = ends.where("at").select(F.col("part").alias("__part"), F.col(key).alias("__lead"))
    needed = before.join(F.broadcast(lead), (F.col("part") == F.col("__part")) & F.col("__key").eqNullSafe(F.col("__lead"))).select("__part", "before")
    told = rows.join(F.broadcast(needed), F.col("at") & (F.col("part") == F.col("__part")), "left")
    start = F.when(F.col("at"), F.col("before")).otherwise(F.col("first"))
    return told.select(key, order, (F.col("mean") + F.pow(F.lit(1 - alpha), "n") * start).cast(df.schema[value].dataType).alias(value))


def changes(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose ``value`` differs from the one before, first rows included."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("before", before).where(~F.col(value).eqNullSafe(F.col("before")))


def flips(df: DataFrame, key: str, order: list[str], value: str, threshold: float, eps: float) -> DataFrame:
    """Rows that cross ``threshold`` or move by ``eps`` from the value before (1 before the first)."""
    before = F.coalesce(F.lag(value).over(Window.partitionBy(key).orderBy(*order)), F.lit(1.0))
    own = df.withColumn("before", before).withColumn("delta", F.round(F.abs(F.col(value) - F.col("before")), 6))
    return own.where(((F.col("before") >= threshold) != (F.col(value) >= threshold)) | (F.col("delta") >= eps))


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows in an order: a top-k report."""
    return df.orderBy(*order).limit(n)


def cumulative(df: DataFrame, order: str) -> DataFrame:
    """(order, n, total): counts by step and their running total. Steps, not rows, meet in the window."""
    counts = df.groupBy(order).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def jaccard_with_previous(df: DataFrame, key: str, order: str, path: str) -> DataFrame:
    """Overlap of each path with the one before, null for the first and where both are empty."""
    before = F.lag(path).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("overlap", F.when(before.isNotNull(), F.size(F.array_intersect(path, before)) / F.nullif(F.size(F.array_union(path, before)), F.lit(0))))


def stuck(df: DataFrame, key: str, order: str, rows: int = 20, least: float = 0.2) -> DataFrame:
    """Rows at which the position moved less than ``least`` over the last ``rows`` positions."""
    by = Window.partitionBy(key).orderBy(order)
    moved = F.hypot(F.col("x") - F.lag("x", rows - 1).over(by), F.col("y") - F.lag("y", rows - 1).over(by))
    return df.withColumn("moved", moved).where(F.col("moved") < least)


def global_row_number(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """Numbers all rows from 1 in an order, without bringing them to one task.

    Rows are range-partitioned, sorted and written with their place in the partition;
    only the partitions' sizes meet in a window.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at") + 1).drop("__part", "__at", "__start")


def hysteresis(df: DataFrame, key: str, order: str, value: str, high: float, low: float) -> DataFrame:
    """Adds ``active``: on at ``high`` or more, off under ``low``, else as before; off at the start."""
    signal = F.when(F.col(value) >= high, True).when(F.col(value) < low, False)
    by = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("active", F.coalesce(F.last(signal, ignorenulls=True).over(by), F.lit(False)))
