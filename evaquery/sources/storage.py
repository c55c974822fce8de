"""The folder that a cluster shares, and frames written there to cut lineage."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. In local mode, tests for one, a temporary folder
    where none is named; on a cluster that would be a folder of one machine, so it is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="evaquery-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/evaquery-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of narrow rows are broadcast up to this number of rows and joined by shuffle beyond.
BROADCAST_ROWS = 200_000


def small(table: DataFrame) -> DataFrame:
    """``table``, to be broadcast if a count of it finds no more rows than the limit, and joined by shuffle if it has more,
    however small its file makes it look."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge")


#: Rows whose Python work one task does; a small file of many rows would be one task whatever its rows cost.
TASK_ROWS = 5_000


def tasks(df: DataFrame, most: int | None = None) -> int:
    """Number of tasks of at most ``most`` rows each that the rows of ``df``, counted now, are dealt over."""
    return max(1, math.ceil(df.count() / (most or TASK_ROWS)))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its keys over as many tasks as hold ``TASK_ROWS`` rows each."""
    return df.repartition(tasks(df), *keys)
