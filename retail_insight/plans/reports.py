"""The reports a user runs on a purchase table, as named DataFrames.

A part whose columns are absent is left out of a report; a report that cannot
exist without certain columns raises ``ValueError``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_insight.operators import overview as ov
from retail_insight.operators.clustering import MODEL_ERRORS
from retail_insight.operators.histogram import rfm_distribution
from retail_insight.operators.overview_scan import KPI_COLUMNS, overview_of
from retail_insight.operators.products import (
    ProductClusters,
    Projection,
    category_names,
    cluster_contents,
    cluster_ids,
    product_clusters,
    product_pca,
    product_profile,
)
from retail_insight.operators.quantiles import describe_metrics
from retail_insight.operators.rfm import rfm
from retail_insight.operators.sampling import cluster_examples
from retail_insight.operators.segments import (
    DETAIL_ROWS,
    Segments,
    cluster_profile,
    label_clusters,
    scatter,
    segment_customers,
    segment_detail,
)
from retail_insight.operators.series import fill_month_gaps, monthly_revenue
from retail_insight.schema import RFM_METRICS, has, require_rows
from retail_insight.sources.workspace import cut_lineage


def overview(df: DataFrame) -> dict[str, DataFrame]:
    """Summary, KPIs and the breakdowns by day, category, payment, gender, age: one scan for all."""
    whole = overview_of(df)
    parts = {"summary": whole.summary()}
    if any(has(df, c) for c in KPI_COLUMNS):
        parts["kpis"] = whole.kpis()
    if has(df, "purchase_date", "total_amount"):
        parts["daily_sales"] = whole.daily_sales()
    if has(df, "product_category"):
        parts["top_categories"] = whole.top_categories()
        if has(df, "total_amount"):
            parts["top_categories_by_revenue"] = parts["top_categories"].orderBy(
                F.desc("revenue"), "product_category"
            )
    if has(df, "payment_method"):
        parts["payment_mix"] = whole.payment_mix()
    if has(df, "purchase_date", "returns"):
        parts["daily_return_rate"] = whole.daily_return_rate()
    if has(df, "churn", "gender"):
        parts["churn_by_gender"] = whole.churn_by_gender()
    if has(df, "customer_age"):
        parts["age_histogram"] = whole.age_histogram()
    return parts


def trends(df: DataFrame) -> dict[str, DataFrame]:
    """Gap-filled monthly revenue, top five categories, payment counts."""
    parts = {}
    if has(df, "purchase_ts", "total_amount"):
        parts["monthly_revenue"] = fill_month_gaps(monthly_revenue(df))
    if has(df, "product_category", "total_amount"):
        parts["top_categories"] = ov.top_categories(df, by="revenue", n=5).select(
            "product_category", "revenue"
        )
    if has(df, "payment_method"):
        parts["payment_counts"] = ov.payment_counts(df)
    return parts


def behaviour(df: DataFrame) -> dict[str, DataFrame]:
    """RFM table, three distributions and summary statistics; charts draw on the whole table."""
    table = cut_lineage(rfm(df, drop_null_ts=False))
    require_rows(table.where(F.col("recency_days").isNotNull()), "customers with a dated purchase")
    parts = {"rfm": table, "scatter": table}
    for metric in RFM_METRICS:
        parts[f"distribution_{metric}"] = rfm_distribution(table, metric)
    parts["statistics"] = describe_metrics(table, RFM_METRICS)
    return parts


@dataclass
class SegmentReport:
    segments: Segments
    profile: DataFrame
    scatter: DataFrame
    detail: DataFrame


def segmentation(df: DataFrame, detail_rows: int = DETAIL_ROWS) -> SegmentReport:
    """Customer segments with labelled profiles, chart points and detail rows."""
    segments = segment_customers(rfm(df, drop_null_ts=True))
    return SegmentReport(
        segments,
        label_clusters(cluster_profile(segments.assigned)),
        scatter(segments.assigned),
        segment_detail(segments.assigned, detail_rows),
    )


@dataclass
class ProductReport:
    """``projection`` and ``chart_labels`` are None when no projection exists."""

    clusters: ProductClusters
    projection: Projection | None
    chart_labels: DataFrame | None
    contents: DataFrame
    categories: DataFrame
    cluster_ids: DataFrame


def product_model(df: DataFrame, k: int = 0) -> ProductReport:
    """Product clusters with projection and contents, ready for recommendations."""
    clusters = product_clusters(product_profile(df), k)
    try:
        projection = product_pca(clusters.assigned)
        chart_labels = cluster_examples(projection.points)
    except MODEL_ERRORS:
        projection = chart_labels = None
    return ProductReport(
        clusters,
        projection,
        chart_labels,
        cluster_contents(clusters.assigned),
        category_names(clusters.assigned),
        cluster_ids(clusters.assigned),
    )
