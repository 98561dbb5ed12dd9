"""Distinct counts against sets, and plans without copies of rows."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerweave.functions.distinct import agg_distinct, distinct_count
from ledgerweave.operators.launch import launch_kpis
from ledgerweave.operators.market import market_kpis


@pytest.mark.parametrize("dense", [True, False])
def test_counts(spark, dense):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(0, 90_000, 7)]), rng.randint(0, 5)) for _ in range(4000)] + [(0, 1), (32_767, 1), (32_768, 1), (65_536, 1)]
    df = spark.createDataFrame(rows, "code bigint, v bigint").repartition(5)
    want = len({c for c, _ in rows if c is not None})
    assert spark.range(1).select(distinct_count(df, "code", dense).alias("n")).first()[0] == want
    got = agg_distinct(df, {"n": F.count(F.lit(1)), "s": F.sum("v")}, F.col("code"), "codes", dense).first()
    assert tuple(got) == (len(rows), sum(v for _, v in rows), want)
    empty = agg_distinct(df.limit(0), {"n": F.count(F.lit(1))}, F.col("code"), "codes", dense).first()
    assert tuple(empty) == (0, 0)


def test_plans(spark):
    sales = spark.createDataFrame([(1, 7, 100, 10), (1, 8, 200, 20), (2, 7, 300, None)], "buyer bigint, asset bigint, price bigint, royalty bigint")
    kpis = market_kpis(sales, F.lit(1.0), 2, 4, dense=True)
    plan = kpis._jdf.queryExecution().toString()
    assert "Expand" not in plan and "hashpartitioning(buyer" not in plan
    row = kpis.first()
    assert (row["secondary_sales"], row["unique_buyers"], row["assets_ever_sold"], row["secondary_volume"]) == (3, 2, 2, 6.0)
    minted = launch_kpis(sales.withColumnRenamed("buyer", "payer"), dense=True)
    assert "hashpartitioning(payer" not in minted._jdf.queryExecution().toString()
    assert minted.first()["unique_minters"] == 2
