"""The overview from one scan against the operators that scan for one part each."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from retail_insight.operators import overview as ov
from retail_insight.operators.histogram import age_histogram
from retail_insight.operators.overview_scan import overview_of, overview_states


def rows(df):
    return [tuple(r) for r in df.collect()]


def odd_purchases(spark):
    day = datetime.date(2024, 2, 28)
    data = [
        (1, day, "a", "card", "f", 30, 10.5, 1, None),
        (1, None, "a", None, None, None, None, None, 1),
        (None, day, None, "cash", "m", 150, 2.25, 0, 0),
        (2, day + datetime.timedelta(2), "b", "card", "f", 30, -4.0, None, 1),
        (2, day + datetime.timedelta(2), "b", "card", "f", 0, None, 1, 0),
    ]
    return spark.createDataFrame(
        data,
        "customer_id long, purchase_date date, product_category string, payment_method string, gender string, "
        "customer_age int, total_amount double, returns int, churn int",
    )


def check(df):
    whole = overview_of(df)
    assert rows(whole.summary()) == rows(ov.table_summary(df))
    assert rows(whole.kpis()) == rows(ov.kpis(df))
    assert rows(whole.daily_sales()) == rows(ov.daily_sales(df))
    assert rows(whole.top_categories()) == rows(ov.top_categories(df))
    assert rows(whole.top_categories("revenue", 2)) == rows(ov.top_categories(df, "revenue", 2))
    assert rows(whole.payment_mix()) == rows(ov.payment_mix(df))
    assert rows(whole.daily_return_rate()) == rows(ov.daily_return_rate(df))
    assert rows(whole.churn_by_gender()) == rows(ov.churn_by_gender(df))
    assert rows(whole.age_histogram()) == rows(age_histogram(df))


def test_parts_equal_the_operators(spark):
    check(odd_purchases(spark))


def test_parts_of_no_purchases(spark):
    check(odd_purchases(spark).limit(0))


@pytest.mark.parametrize("left", [["customer_id", "total_amount"], ["returns"], ["gender", "churn"], ["purchase_date"]])
def test_absent_columns(spark, left):
    df = odd_purchases(spark).select(*left)
    whole = overview_of(df)
    assert rows(whole.summary()) == rows(ov.table_summary(df))
    if left != ["purchase_date"]:
        assert rows(whole.kpis()) == rows(ov.kpis(df))
    with pytest.raises(ValueError, match="missing required columns"):
        whole.payment_mix()


def test_one_scan_and_two_exchanges(spark):
    plan = overview_states(odd_purchases(spark).repartition(3))._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert len(re.findall(r"Expand ", plan)) == 1
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
    assert len(re.findall(r"Scan ", plan)) == 1


def test_states_do_not_grow_with_customers(spark):
    many = spark.range(5_000).select(
        F.col("id").alias("customer_id"), F.lit("x").alias("gender"), F.lit(1).alias("churn"), F.lit(2.5).alias("total_amount")
    )
    states = overview_states(many).collect()
    assert len(states) == 2 and {r.breakdown: r.groups for r in states} == {"customer_id": 5_000, "gender": 1}
