"""Sorts keep the order they promise; the SQL comparison of all queries sorts both sides."""

import pytest

from evaquery import catalog
from evaquery.operators import aggregates, dq, windows
from evaquery.plans import sim
from evaquery.sources import domain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["s06_node_scan", "o03_levels_in_order", "o04_faces_by_area", "o07_top_changes", "o10_first_errors"])
def test_rows_come_in_the_order_of_the_sql(spark, name):
    from . import oracle

    res = oracle.connect(SF).execute(catalog.ORACLE[name])
    columns = [c[0] for c in res.description]
    df = catalog.QUERIES[name](spark, SF).select(*columns)
    plain = lambda rows: [tuple(map(oracle.plain, r)) for r in rows]
    assert plain(df.collect()) == plain(res.fetchall())


def test_numbers_follow_the_order(spark):
    c = domain.cells(spark, SF).select("cell", "w", "h")
    got = sorted((r.n, -r.w, r.h, r.cell) for r in windows.global_row_number(c.selectExpr("cell", "w", "h", "-w as low"), "low", "h", "cell").collect())
    assert [x[0] for x in got] == list(range(1, len(got) + 1)) and [x[1:] for x in got] == sorted(x[1:] for x in got)


def test_activation_orders_differ_by_step_and_repeat(spark):
    agents = spark.range(50).toDF("agent")
    order = lambda step: [r.agent for r in sim.activation(agents.repartition(5), step).orderBy("place").collect()]
    assert order(1) == order(1) != order(2) and sorted(order(2)) == list(range(50))


def test_reports(spark):
    overlaps = spark.createDataFrame([(1, k, float(k % 7)) for k in range(2, 40)], "a int, b int, area double")
    rows = dq.warnings_by_cell(overlaps).collect()
    assert sum(r.cell == 1 for r in rows) == 20 and len(rows) == 20 + 38
    t = spark.createDataFrame([("a", 3, 1), ("a", 3, 0), ("b", None, 5), ("a", 1, 9)], "by string, size int, k int")
    assert sorted((r.by, r["size"], r.k) for r in aggregates.largest(t, "by", "size", "k").collect() if r.by == "a") == [("a", 3, 0)]
