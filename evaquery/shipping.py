"""Sends this package to the executors, whose Python finds only what it is sent or has installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, once a context.

    The archive is made on the driver, and Spark's own file server hands it to executors,
    those that join later included.
    """
    sc = spark.sparkContext
    if getattr(sc, "_evaquery_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.parent.is_dir():  # not itself read from an archive
        path = Path(tempfile.mkdtemp(prefix="evaquery-")) / "evaquery-sources.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, str(file.relative_to(root.parent)))
        sc.addPyFile(str(path))
    sc._evaquery_shipped = True
