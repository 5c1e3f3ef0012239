"""Aggregates, series, quantiles and histograms on small tables and edge cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retail_insight.operators import overview as ov
from retail_insight.operators.histogram import age_histogram, histogram, rfm_distribution
from retail_insight.operators.quantiles import (
    describe_metrics,
    exact_quantiles,
    ranked_values,
    trim_quantile,
)
from retail_insight.operators.rfm import rfm
from retail_insight.operators.sampling import cluster_examples, hash_sample
from retail_insight.operators.series import fill_month_gaps, monthly_revenue, moving_average
from retail_insight.schema import has, require, require_rows


def numbers(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double")


@pytest.fixture(scope="module")
def purchases(spark):
    return spark.sql(
        """SELECT id, CAST(ts AS TIMESTAMP) AS purchase_ts, CAST(ts AS DATE) AS purchase_date, * EXCEPT (id, ts)
        FROM VALUES
          (1, '2020-01-01 23:00', 10, 'a', 'card', 100.0D, 1, 'f', 0, 30),
          (2, '2020-01-03 01:00', 10, 'b', 'cash', 50.0D, 0, 'f', NULL, 30),
          (3, '2020-01-03 02:00', 20, 'a', 'card', NULL, 0, 'm', NULL, 0),
          (4, NULL, 20, 'b', 'cash', 7.0D, NULL, 'm', NULL, 120),
          (5, NULL, 30, 'c', 'card', 1.0D, 0, 'f', 1, NULL)
        AS t(id, ts, customer_id, product_category, payment_method, total_amount, returns, gender, churn, customer_age)"""
    )


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_guards(purchases):
    assert has(purchases, "churn") and not has(purchases, "churn", "nope")
    with pytest.raises(ValueError, match="nope, other"):
        require(purchases, "churn", "nope", "other")
    with pytest.raises(ValueError, match="no usable rows"):
        require_rows(purchases.where("false"), "anything")


def test_kpis(purchases):
    assert rows(ov.kpis(purchases)) == [(3, 3, 158.0, 25.0, 50.0)]
    assert ov.kpis(purchases.select("returns")).columns == ["return_rate_pct"]
    assert rows(ov.kpis(purchases.where("false").select("returns", "total_amount"))) == [(None, 0.0)]
    with pytest.raises(ValueError):
        ov.kpis(purchases.select("id"))


def test_daily_sales(purchases):
    found = rows(ov.daily_sales(purchases))
    assert found == [(dt.date(2020, 1, 1), 100.0, 1, 100.0), (dt.date(2020, 1, 3), 50.0, 2, 75.0)]


def test_daily_return_rate(purchases):
    assert rows(ov.daily_return_rate(purchases)) == [(dt.date(2020, 1, 1), 1.0), (dt.date(2020, 1, 3), 0.0)]


def test_churn_rate_of_a_group_without_flags_is_null(purchases):
    assert rows(ov.churn_by_gender(purchases)) == [("f", 0.5), ("m", None)]


def test_breakdowns(purchases):
    assert rows(ov.top_categories(purchases, n=2)) == [("a", 2, 100.0), ("b", 2, 57.0)]
    assert rows(ov.top_categories(purchases, by="revenue", n=1)) == [("a", 2, 100.0)]
    assert rows(ov.payment_mix(purchases)) == [("card", 3, 101.0), ("cash", 2, 57.0)]
    assert rows(ov.payment_counts(purchases)) == [("card", 3), ("cash", 2)]
    unpriced = purchases.drop("total_amount")
    assert ov.top_categories(unpriced).columns == ["product_category", "cnt"]
    assert ov.payment_mix(unpriced).columns == ["payment_method", "cnt"]
    with pytest.raises(ValueError):
        ov.top_categories(unpriced, by="revenue")


def test_category_counts_add_up_to_the_rows(purchases):
    assert ov.top_categories(purchases).agg(F.sum("cnt")).first()[0] == purchases.count()


def test_summary(purchases):
    row = ov.table_summary(purchases).first()
    assert (row.row_count, row.column_count, row.columns) == (5, 11, purchases.columns)


def test_moving_average_skips_nulls_and_keeps_entities_apart(spark):
    df = spark.createDataFrame(
        [("a", 1, 1.0), ("a", 2, None), ("a", 3, 5.0), ("b", 1, 10.0), ("b", 2, None)],
        "e string, t int, v double",
    )
    found = moving_average(df, "v", "t", rows=2, name="m", by=["e"]).orderBy("e", "t")
    assert [r.m for r in found.collect()] == [1.0, 1.0, 5.0, 10.0, 10.0]
    only_null = moving_average(df.where("v IS NULL"), "v", "t")
    assert [r.moving_avg for r in only_null.collect()] == [None, None]


def test_month_gaps(spark):
    df = spark.sql(
        """SELECT CAST(m AS DATE) AS month, r AS revenue FROM VALUES
        ('2019-11-01', 5.0D), ('2020-02-01', NULL), ('2020-03-01', 7.0D) AS t(m, r)"""
    )
    assert [(str(m), r) for m, r in rows(fill_month_gaps(df))] == [
        ("2019-11-01", 5.0), ("2019-12-01", 0.0), ("2020-01-01", 0.0), ("2020-02-01", None), ("2020-03-01", 7.0),
    ]
    assert rows(fill_month_gaps(df.where("false"))) == []


def test_monthly_revenue(purchases):
    assert rows(monthly_revenue(purchases)) == [(dt.date(2020, 1, 1), 150.0)]


def test_rfm_with_and_without_undated_purchases(purchases):
    everything = rows(rfm(purchases, drop_null_ts=False).orderBy("customer_id"))
    assert everything == [(10, 0, 2, 150.0), (20, 0, 2, 7.0), (30, None, 1, 1.0)]
    # Customer 20 has a dated purchase, but without an amount.
    assert rows(rfm(purchases, drop_null_ts=True)) == [(10, 0, 2, 150.0)]
    with pytest.raises(ValueError):
        rfm(purchases.drop("purchase_ts"))


def test_recency_counts_calendar_days(spark):
    df = spark.sql(
        """SELECT CAST(ts AS TIMESTAMP) AS purchase_ts, c AS customer_id, 1.0D AS total_amount FROM VALUES
        ('2020-01-01 23:59', 1), ('2020-01-02 00:01', 2) AS t(ts, c)"""
    )
    assert sorted(rows(rfm(df))) == [(1, 1, 1, 1.0), (2, 0, 1, 1.0)]


def test_purchases_are_grouped_once_for_rfm(purchases):
    df = rfm(purchases)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("shape", ["spread", "tied", "heavy tail", "tiny", "one"])
def test_quantiles_are_exact(spark, shape):
    draw = random.Random(3)
    values = {
        "spread": [draw.random() for _ in range(20_000)],
        "tied": [float(draw.choice([0, 0, 0, 1, 2, 50])) for _ in range(20_000)],
        "heavy tail": [draw.paretovariate(0.5) for _ in range(20_000)],
        "tiny": [4.0, 1.0, 3.0],
        "one": [5.0],
    }[shape]
    wanted = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    df = numbers(spark, values + [None] * 5).repartition(7)
    found = exact_quantiles(df, "x", wanted).first()[0]
    assert found == pytest.approx(list(np.quantile(values, wanted)), rel=1e-12)


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(numbers(spark, [None]), "x", [0.5]).first()[0] == [None]


def test_ranges_share_distinct_values_out(spark):
    """No range of all-distinct values is much larger than another."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = ranked_values(spark.range(80_000).select(F.col("id").cast("double").alias("x")), ["x"])
        ranked.collect()
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        sizes = [r["count"] for r in ranked.groupBy(F.floor(F.col("before") / 10_000)).count().collect()]
        assert "percentile" not in plan and sizes == [10_000] * 8
        assert ranked.where("value <> before").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trim_keeps_values_up_to_the_quantile(spark):
    values = [float(v) for v in range(1, 201)]
    kept = [r.x for r in trim_quantile(numbers(spark, values + [None]), "x", 0.99).collect()]
    assert sorted(kept) == [v for v in values if v <= np.quantile(values, 0.99)]


def test_describe(spark):
    values = [1.0, 2.0, 2.0, 9.0]
    row = describe_metrics(numbers(spark, values + [None]), ["x"]).first()
    assert row.metric == "x" and row.n == 4
    found = [row["mean"], row["std"], row["min"], row.p25, row.p50, row.p75, row["max"]]
    assert found == pytest.approx(
        [np.mean(values), np.std(values, ddof=1), 1.0, *np.quantile(values, [0.25, 0.5, 0.75]), 9.0]
    )


@pytest.mark.parametrize("bins", [1, 3, 10, 30, 40])
def test_histogram_equals_numpy(spark, bins):
    draw = random.Random(bins)
    for values in (
        [round(draw.uniform(-5, 5), 1) for _ in range(3000)],
        [float(draw.randint(0, 120)) for _ in range(3000)],
        [0.1 * i for i in range(101)],
        [draw.gauss(1e6, 3.0) for _ in range(500)],
    ):
        found = histogram(numbers(spark, values + [None]), "x", bins).collect()
        counts, edges = np.histogram(values, bins)
        assert [r.bin for r in found] == list(range(bins))
        assert [r.n for r in found] == list(counts)
        assert [r.center for r in found] == pytest.approx(list((edges[:-1] + edges[1:]) / 2))


def test_histogram_of_one_value_and_of_nothing(spark):
    found = rows(histogram(numbers(spark, [7.0, 7.0]), "x", 2))
    assert found == [(0, 6.75, 0), (1, 7.25, 2)]
    assert rows(histogram(numbers(spark, [None]), "x", 4)) == []
    with pytest.raises(ValueError):
        histogram(numbers(spark, [1.0]), "x", 0)


@pytest.mark.parametrize("n, bins", [(50, 10), (400, 20), (10_000, 40)])
def test_age_histogram_bin_count(spark, n, bins):
    ages = spark.range(n).select((F.col("id") % 140 - 20).alias("customer_age"))
    found = age_histogram(ages).collect()
    kept = ages.where("customer_age > 0 AND customer_age < 100").count()
    assert len(found) == int(np.clip(np.sqrt(kept), 10, 40))
    assert sum(r.n for r in found) == kept


def test_rfm_distribution_trims_all_but_recency(spark):
    df = spark.range(1000).select(
        F.col("id").cast("int").alias("recency_days"), (F.col("id") * F.col("id")).alias("frequency")
    )
    assert sum(r.n for r in rfm_distribution(df, "recency_days").collect()) == 1000
    assert sum(r.n for r in rfm_distribution(df, "frequency").collect()) == 990


def test_samples_depend_on_the_keys_alone(spark):
    one = spark.range(5000).withColumnRenamed("id", "k")
    other = one.repartition(13).orderBy(F.desc("k"))
    assert sorted(rows(hash_sample(one, 0.2, "k"))) == sorted(rows(hash_sample(other, 0.2, "k")))
    assert abs(hash_sample(one, 0.2, "k").count() - 1000) < 150
    assert hash_sample(one, 1, "k").count() == 5000 and hash_sample(one, 0, "k").count() == 0
    assert rows(hash_sample(one, 0.2, "k", seed=1)) != rows(hash_sample(one, 0.2, "k", seed=2))
    assert hash_sample(one.limit(0), 0.5, "k").count() == 0
    with pytest.raises(ValueError, match="fraction"):
        hash_sample(one, 2, "k")


@pytest.mark.parametrize("n", [1, 3, 1500])
def test_examples_in_two_stages(spark, n):
    members = spark.range(4000).select(
        F.col("id").cast("string").alias("product_category"), (F.col("id") % 2).cast("int").alias("prediction")
    )
    found = cluster_examples(members, n).collect()
    assert len(found) == 2 * n
    fewer = {r.product_category for r in cluster_examples(members, max(1, n // 2)).collect()}
    assert fewer <= {r.product_category for r in found}
