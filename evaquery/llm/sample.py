"""Bounded, repeatable samples of labelled rows, for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(folds)).cast("int")


def sampled(rows: DataFrame, label: str, per_label: int, most_rows: int, key: str = "doc_id", seed: int = 17) -> list:
    """``per_label`` rows of every label, fewer of each if they would exceed ``most_rows``, collected.

    Rows are told by all their columns and drawn by the hash of them: of each label those
    with the least hashes, so the same table gives the same sample in any partitioning,
    rows that share a key are drawn one by one and equal ones count once. Every label is
    counted and has a row in the sample. With more labels than ``most_rows`` there is
    no such sample, which is an error. What comes to the driver is bounded by ``most_rows``.
    """
    whole = 1 << 62
    drawn = rows.where(F.col(label).isNotNull()).withColumn("__draw", F.pmod(F.xxhash64(*rows.columns, F.lit(seed)), F.lit(whole)))
    pairs = drawn.select(label, "__draw").distinct()
    counts = pairs.groupBy(label).count().orderBy(label).limit(most_rows + 1).collect()
    if not counts:
        return []
    if len(counts) > most_rows:
        raise ValueError(f"more than {most_rows} labels")
    each = min(per_label, most_rows // len(counts))
    # A label's least hashes lie under a bound that twice as many and 60 more are expected to pass.
    bound = F.create_map(*[F.lit(x) for r in counts for x in (r[label], min(whole, int(whole * (2 * each + 60) / r["count"])))])
    near = pairs.where(F.col("__draw") < bound[F.col(label)])
    least = near.groupBy(label).agg(F.slice(F.array_sort(F.collect_list("__draw")), 1, each).alias("draws"))
    taken = drawn.join(F.broadcast(least.select(label, F.explode("draws").alias("__draw"))), [label, "__draw"])
    once = taken.groupBy(label, "__draw").agg(F.min(F.struct(*[F.col(c) for c in rows.columns])).alias("row")).select("row.*").collect()
    return sorted(once, key=lambda r: (r[key] is None, *map(str, r)))
