"""Overview metrics: KPIs and breakdowns by day, category, payment and gender.

Every grouping here is algebraic, so Spark combines inside each map task and a
hot key costs one row per task in the shuffle, whatever its share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_insight.functions.measures import average, exact_part, large_part, total
from retail_insight.operators.overview_scan import KPI_COLUMNS, Overview, overview_states, with_mean_revenue
from retail_insight.schema import has, require


def table_summary(df: DataFrame) -> DataFrame:
    """Row count, column count and column names, as one row."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
    )


def kpis(df: DataFrame) -> DataFrame:
    """Customers, categories, revenue, return and churn percent in one pass.

    A figure whose column is absent is left out. Customers and categories are
    two sets of one grouping: each purchase is combined under either in the map
    tasks, and no pair of the two is ever counted.
    """
    narrow = df.select(*[c for c in KPI_COLUMNS if has(df, c)])
    return Overview(overview_states(narrow), narrow.columns).kpis()


def daily_sales(df: DataFrame) -> DataFrame:
    """Revenue, order count and 7-row trailing mean revenue per day on record."""
    require(df, "purchase_date", "total_amount")
    exact, large = F.sum(exact_part("total_amount")), F.sum(large_part("total_amount"))
    daily = (
        df.where(F.col("purchase_date").isNotNull())
        .groupBy("purchase_date")
        .agg(exact.alias("exact"), large.alias("large"), F.count(F.lit(1)).alias("orders"))
    )
    return with_mean_revenue(daily)


def top_categories(df: DataFrame, by: str = "cnt", n: int = 10) -> DataFrame:
    """The ``n`` largest categories by ``cnt`` or ``revenue``, ties by name."""
    require(df, "product_category")
    measures = [F.count(F.lit(1)).alias("cnt")]
    if has(df, "total_amount"):
        measures.append(total("total_amount").alias("revenue"))
    elif by == "revenue":
        require(df, "total_amount")
    return (
        df.groupBy("product_category")
        .agg(*measures)
        .orderBy(F.desc(by), "product_category")
        .limit(n)
    )


def payment_mix(df: DataFrame) -> DataFrame:
    """Orders and revenue per payment method, most used first."""
    require(df, "payment_method")
    measures = [F.count(F.lit(1)).alias("cnt")]
    if has(df, "total_amount"):
        measures.append(total("total_amount").alias("revenue"))
    return df.groupBy("payment_method").agg(*measures).orderBy(F.desc("cnt"), "payment_method")


def payment_counts(df: DataFrame) -> DataFrame:
    """Orders per payment method, most used first."""
    require(df, "payment_method")
    return (
        df.groupBy("payment_method")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), "payment_method")
    )


def daily_return_rate(df: DataFrame) -> DataFrame:
    """Share of returned purchases per day on record."""
    require(df, "purchase_date", "returns")
    return (
        df.where(F.col("purchase_date").isNotNull())
        .groupBy("purchase_date")
        .agg(average("returns").alias("return_rate"))
        .orderBy("purchase_date")
    )


def churn_by_gender(df: DataFrame) -> DataFrame:
    """Share of churned purchases per gender; unknown churn does not count."""
    require(df, "churn", "gender")
    return df.groupBy("gender").agg(average("churn").alias("churn_rate")).orderBy("gender")
