import itertools

from pyspark.sql import functions as F

from evaquery import catalog
from evaquery.operators import aggregates

HIGH = [4.99, 2.48, 63.45, 129.08]  # their mean is 50, that of their doubles above it in any order


def test_a_mean_on_a_bound_does_not_depend_on_the_order_of_its_rows(spark, tmp_path):
    assert all(sum(p) / 4 > 50 for p in itertools.permutations(HIGH))
    rows = [(i, 0, "view", v) for i, v in enumerate(HIGH)] + [(9, 1, "view", 50.01)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").selectExpr("*", "timestamp_ntz'2024-01-01' AS ts", "'' AS props").write.parquet(f"{tmp_path}/events.parquet")
    assert {tuple(r) for r in catalog.QUERIES["a21_noisy_or_risk"](spark, str(tmp_path)).collect()} == {(0, 0.0825), (1, 0.165)}


def test_means_of_other_doubles_are_the_plain_ones(spark):
    third, none, nan, inf = 1 / 3, None, float("nan"), float("inf")
    rows = [(0, third), (0, third), (1, none), (2, none), (2, 4.0), (3, nan), (3, 1.0), (4, inf), (4, 1.0), (5, 1e300), (5, 1e300), (6, 1e18), (6, 2e18), (7, -0.0)]
    got = spark.createDataFrame(rows, "k int, v double").groupBy("k").agg(aggregates.steady_mean(F.col("v")).alias("m")).collect()
    assert {k: repr(m) for k, m in got} == {0: repr(third), 1: "None", 2: "4.0", 3: "nan", 4: "inf", 5: "1e+300", 6: "1.5e+18", 7: "0.0"}
