"""The five reports over the order tables, and what they leave out."""

import pytest
from pyspark.sql import functions as F

from retail_insight.plans import reports
from retail_insight.sources.facts import facts
from retail_insight.sources.workspace import cut_lineage, new_path, shared_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def purchases(spark):
    return facts(spark, SF).withColumn("product_category", F.col("brand")).persist()


def test_overview(purchases):
    parts = reports.overview(purchases)
    assert list(parts) == [
        "summary", "kpis", "daily_sales", "top_categories", "top_categories_by_revenue",
        "payment_mix", "daily_return_rate", "churn_by_gender", "age_histogram",
    ]
    counts = {name: df.count() for name, df in parts.items()}
    assert counts["top_categories"] == counts["top_categories_by_revenue"] == 10
    by_count = {r.product_category for r in parts["top_categories"].collect()}
    by_revenue = [r for r in parts["top_categories_by_revenue"].collect()]
    assert {r.product_category for r in by_revenue} == by_count
    assert [r.revenue for r in by_revenue] == sorted((r.revenue for r in by_revenue), reverse=True)


def test_overview_of_few_columns(purchases):
    assert list(reports.overview(purchases.select("brand"))) == ["summary"]
    assert list(reports.overview(purchases.select("product_category"))) == ["summary", "kpis", "top_categories"]


def test_trends(purchases):
    parts = reports.trends(purchases)
    assert {name: df.columns for name, df in parts.items()} == {
        "monthly_revenue": ["month", "revenue"],
        "top_categories": ["product_category", "revenue"],
        "payment_counts": ["payment_method", "cnt"],
    }
    assert parts["top_categories"].count() == 5
    assert reports.trends(purchases.select("brand")) == {}


def test_behaviour(purchases):
    parts = reports.behaviour(purchases)
    customers = parts["rfm"].count()
    assert parts["scatter"].count() == customers
    assert sum(r.n for r in parts["distribution_recency_days"].collect()) == customers
    assert [r.metric for r in parts["statistics"].collect()] == ["recency_days", "frequency", "monetary"]
    undated = purchases.withColumn("purchase_ts", F.lit(None).cast("timestamp"))
    with pytest.raises(ValueError, match="no usable rows"):
        reports.behaviour(undated)
    with pytest.raises(ValueError, match="missing required columns"):
        reports.behaviour(purchases.drop("total_amount"))


def test_segmentation(purchases):
    report = reports.segmentation(purchases)
    profile = report.profile.collect()
    assert len(profile) == report.segments.choice.k
    assert sum(r.n_customers for r in profile) == report.segments.assigned.count()
    assert report.detail.count() <= 200 and reports.segmentation(purchases, 3).detail.count() == 3
    assert report.scatter.columns[-1] == "prediction"


def test_product_model(purchases):
    report = reports.product_model(purchases)
    assert report.projection.points.count() == report.categories.count() == 25
    assert report.contents.count() == 25
    assert report.chart_labels.count() <= 3 * report.cluster_ids.count()
    two = purchases.where("product_category IN ('Brand#1', 'Brand#2')")
    assert reports.product_model(two, k=2).categories.count() == 2


def test_lineage_is_cut_in_the_shared_folder(spark):
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert "Range" not in df._jdf.queryExecution().toString()
    assert "parquet" in df._jdf.queryExecution().toString().lower()
    assert new_path(spark, "a") != new_path(spark, "a")
    assert shared_dir(spark)
