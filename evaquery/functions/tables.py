"""Table-valued functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="part bigint, x0 double, y0 double, x1 double, y1 double")
class SubdivideLShape:
    """The two boxes of a room of w by h whose upper right corner, a by b, is cut out; one box where nothing is cut."""

    def eval(self, w: float, h: float, a: float, b: float) -> Iterator[tuple]:
        if None in (w, h, a, b):
            return
        if a <= 0 or b <= 0:
            yield 0, 0.0, 0.0, w, h
            return
        yield 0, 0.0, 0.0, w, h - b
        yield 1, 0.0, h - b, w - a, h


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL: ``FROM t, LATERAL subdivide_l_shape(w, h, a, b)``."""
    spark.udtf.register("subdivide_l_shape", SubdivideLShape)
