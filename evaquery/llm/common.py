"""What the corpus operators share: columns by name, shared storage, Arrow maps."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship


def col(name: str) -> Column:
    """A top-level column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(doc_id bigint, text string, *more): the columns an operator reads, a null text as empty.

    Everything else of ``docs`` is left behind, so columns of any name may ride along.
    """
    ship(docs.sparkSession)
    return docs.select(col(id_col).cast("bigint").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"), *[col(c).alias(c) for c in more])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    In local mode, tests for one, a temporary folder is set once where none is named; on a
    cluster that would be a folder of one machine, so it is an error there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="evaquery-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


_scratch = threading.local()


def _open() -> list[list[str]]:
    """The pieces of work that are open in this thread, each with what it stored."""
    if not hasattr(_scratch, "open"):
        _scratch.open = []
    return _scratch.open


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, what ``stored`` wrote inside; for work whose own result is written before."""
    _open().append([])
    try:
        yield
    finally:
        for path in _open().pop():
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when each is done, by Spark's own setting, which is put back after."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors.

    Within ``scratch`` the files go at its end unless they are to be kept, in which case those
    that an enclosing ``scratch`` holds go at its end; elsewhere they stay, as a frame that reads them may be used at any time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evaquery-{uuid.uuid4().hex}"
    held = _open()[:-1] if keep else _open()
    if held:
        held[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of 100 bytes a row or less are broadcast up to this number of rows and joined by shuffle beyond.
BROADCAST_ROWS = 200_000


def small(table: DataFrame, beyond: str = "merge", width: Column | None = None) -> DataFrame:
    """``table``, to be broadcast if a count of it finds no more rows than the limit.

    For stored tables of narrow rows; of rows that hold arrays, ``width`` gives the bytes,
    which are summed and held to as many as the limit allows. Beyond it the join
    shuffles, as the hint ``beyond`` says; since neither side is aggregated in the join's
    own stage, adaptive execution can split a hot key.
    """
    fits = table.count() <= BROADCAST_ROWS if width is None else (table.agg(F.sum(width)).first()[0] or 0) <= 100 * BROADCAST_ROWS
    return F.broadcast(table) if fits else table.hint(beyond)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of ``df`` has it, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key with more than one in so many of all rows is hot; there are fewer hot keys than this.
HOT_SHARE = 2000


def joined_by(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """``left`` with the columns of ``right``, which has a row a key or none, as a left join.

    ``sizes`` has the rows (key, n) of every key of ``left``. Rows of hot keys, of which
    there are at most HOT_SHARE, meet a broadcast of theirs where they are; all others
    are joined by shuffle, so no task gets more than its share of one key.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = stored(sizes.where(F.col("n") * HOT_SHARE > total).select(key).join(right, key, "left"))
    spread = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right, key, "left")
    return left.join(F.broadcast(hot), key).unionByName(spread)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, on whatever file system its path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def arrow_map(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: StructType | str, slice_bytes: int = 8 << 20) -> DataFrame:
    """Maps Arrow batches column-wise: ``rows`` gets lists by column name and returns lists by name."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, slice_bytes):
                made = rows({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1500) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows in jobs that start inside; the setting is put back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sliced(batch: pa.RecordBatch, target_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``target_bytes``, one row at least: Python objects are made for a slice at a time."""
    if batch.num_rows:
        step = max(1, int(batch.num_rows * target_bytes / max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
