"""Grouped reports whose values lie on an edge."""

import duckdb
import pytest
from pyspark.sql import functions as F

from reprolith.operators import reports as R
from reprolith.plans.report_queries import QUERIES

LINEITEM = "/root/testdata/sf0.01/lineitem.parquet"


@pytest.mark.parametrize("name", ["a22_strata", "a23_stratum_rows"])
def test_a_mean_on_an_edge_is_that_of_sql_however_rows_are_dealt(spark, tmp_path, name):
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{LINEITEM}'")
    want = sorted(con.sql(QUERIES[name][1]).fetchall())
    lines = spark.read.parquet(LINEITEM)  # suppliers 35 and 60 have a mean discount of 0.05, which is the edge 0.6
    for parts in (1, 12):
        lines.repartition(parts).write.parquet(f"{tmp_path}/{parts}/lineitem.parquet")
        assert sorted(map(tuple, QUERIES[name][0](spark, f"{tmp_path}/{parts}").collect())) == want


def test_strata_are_the_same_in_any_order_of_rows(spark):
    values = [0.2, 0.35, 0.6, 0.7, 0.8, 0.95]  # up, their double sum / 6 is 0.6, down it is 0.6000000000000001
    for x in (values, values[::-1]):
        df = spark.createDataFrame([("k", v) for v in x], "k string, v double").coalesce(1)
        assert R.strata(df, "k", "v", "v").first().stratum == "hard"
        assert {r.stratum for r in R.strata_rows(df, "k", "v", "v").collect()} == {"hard"}


def test_strata_of_values_that_decimals_lack(spark):
    data = {"nan": [0.5, float("nan")], "inf": [float("inf"), 0.1], "down": [float("-inf")], "huge": [1e30, 0.5], "tiny": [1e-300], "none": [None], "some": [None, 0.8], "zero": [0.0, -0.0], "one": [1.0, 1.0], "over": [1.0, 1.0000000001]}
    rows = [(k, v) for k, x in data.items() for v in x]
    got = {r.k: r.s for r in spark.createDataFrame(rows, "k string, v double").coalesce(1).groupBy("k").agg(R.stratum(F.col("v")).alias("s")).collect()}
    assert got == {"tiny": "hard", "some": "medium", "one": "easy"} | dict.fromkeys(["nan", "inf", "down", "huge", "none", "zero", "over"])
