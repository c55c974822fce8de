from pyspark.sql import functions as F

from evaquery import catalog
from evaquery.sources.domain import table
from tests.oracle import connect, mismatch

SF = "/root/testdata/sf0.001"


def parts_from(spark, tmp_path, first):
    """The parts of the smallest tables with keys from ``first`` on."""
    at = str(tmp_path)
    table(spark, SF, "part").withColumn("p_partkey", F.col("p_partkey") + first).write.parquet(f"{at}/p")
    (tmp_path / "p").rename(tmp_path / "part.parquet.d")
    part = next((tmp_path / "part.parquet.d").glob("part-*.parquet"))
    part.rename(tmp_path / "part.parquet")
    return at


def test_the_next_database_id_is_cut_as_the_databases_lpad_does(spark, tmp_path):
    at = parts_from(spark, tmp_path, 9_990)
    assert not mismatch(catalog.QUERIES["x01_database_ids"](spark, at), catalog.ORACLE["x01_database_ids"], connect(at))


def test_node_ids_beyond_six_digits_are_cut_as_the_databases_lpad_does(spark, tmp_path):
    at = parts_from(spark, tmp_path, 999_990)
    assert not mismatch(catalog.QUERIES["b16_nodes"](spark, at), catalog.ORACLE["b16_nodes"], connect(at))
