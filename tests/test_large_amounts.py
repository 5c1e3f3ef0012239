"""Amounts that no decimal holds, and more buckets than the session allows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from retail_insight.functions.clean import clean_money
from retail_insight.functions.measures import total
from retail_insight.operators import overview as ov
from retail_insight.operators.overview_scan import overview_of
from retail_insight.operators.rfm import rfm
from retail_insight.sources.workspace import stage_by

DAYS = "customer_id long, amount string, purchase_date date, product_category string, payment_method string"


def purchases(spark, amounts):
    rows = [(1 + i % 2, a, f"2024-01-{1 + i:02d}", "toys", "card") for i, a in enumerate(amounts)]
    df = spark.createDataFrame(rows, DAYS.replace("date date", "date string"))
    df = df.withColumn("purchase_date", F.col("purchase_date").cast("date"))
    return df.withColumn("total_amount", clean_money(F.col("amount"))).withColumn("purchase_ts", F.col("purchase_date").cast("timestamp"))


@pytest.mark.parametrize(
    ("amounts", "wanted"),
    [
        (["1e30", "12.5", "0.25"], 1e30),
        (["1e22", "-1e22", "12.5"], 12.5),
        (["-1e400", "5.0", "7"], -math.inf),
        (["5.0", "none", "7"], 12.0),
        (["none", "n/a"], None),
        (["999999999999999999999", "1"], 1e21),
    ],
)
def test_no_amount_stops_a_report(spark, amounts, wanted):
    df = purchases(spark, amounts)
    assert df.agg(total("total_amount")).first()[0] == wanted
    assert ov.kpis(df).first().revenue == wanted
    assert ov.payment_mix(df).first().revenue == wanted
    assert overview_of(df).top_categories("revenue").first().revenue == wanted
    assert [tuple(r) for r in overview_of(df).daily_sales().collect()] == [tuple(r) for r in ov.daily_sales(df).collect()]
    assert rfm(df, drop_null_ts=False).count() == min(2, len(amounts))


def test_an_amount_that_is_no_number_makes_the_sum_none(spark):
    df = spark.createDataFrame([(1.5,), (math.nan,), (2.0,)], "total_amount double")
    assert math.isnan(df.agg(total("total_amount")).first()[0])


def test_trailing_mean_around_a_large_day(spark):
    rows = ov.daily_sales(purchases(spark, ["1.0", "1e30", *["2.0"] * 8])).collect()
    assert [r.rev_ma7 for r in rows[2:8]] == [1e30 / (k + 1) for k in range(2, 7)] + [1e30 / 7]
    assert [r.rev_ma7 for r in rows[8:]] == [2.0, 2.0]


def test_sums_below_do_not_depend_on_the_order(spark):
    rng = random.Random(3)
    values = [(rng.uniform(-1e6, 1e6),) for _ in range(2_000)]
    sums = set()
    for parts in (1, 3, 8):
        rng.shuffle(values)
        sums.add(spark.createDataFrame(values, "total_amount double").repartition(parts).agg(total("total_amount")).first()[0])
    assert len(sums) == 1


def test_more_buckets_than_allowed(spark):
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", 64)
    try:
        staged = stage_by(spark.range(100).withColumnRenamed("id", "chunk"), "chunk", 1_000_000, "many")
        assert staged.count() == 100
        joined = staged.join(spark.range(50).withColumnRenamed("id", "chunk"), "chunk")
        assert joined.count() == 50
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
