"""Time-series operators over per-day and per-month aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retail_insight.functions.clean import month_start
from retail_insight.functions.measures import total, whole
from retail_insight.schema import require


def moving_average(
    df: DataFrame,
    value: str,
    order: str,
    rows: int = 7,
    name: str = "moving_avg",
    by: Sequence[str] = (),
    large: str | None = None,
) -> DataFrame:
    """Mean of the last ``rows`` rows on record; nulls are skipped.

    ``large`` names a second part of the value, to be added to the first.
    Meant for aggregates with one row per date. Without ``by`` the window sorts
    in one task, which the calendar bounds: at most 366 rows per year, whatever
    the size of the purchases behind them.
    """
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - rows, Window.currentRow)
    added, known = F.sum(value).over(frame).cast("double"), F.col(value)
    if large:
        added = whole(F.sum(value).over(frame), F.sum(large).over(frame))
        known = whole(F.col(value), F.col(large))
    return df.withColumn(name, added / F.count(known).over(frame))


def monthly_revenue(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Revenue per month on record, within each ``by``."""
    require(df, "purchase_ts", "total_amount", *by)
    return (
        df.where(F.col("purchase_ts").isNotNull())
        .groupBy(*by, month_start(F.col("purchase_ts")).alias("month"))
        .agg(total("total_amount").alias("revenue"))
        .orderBy(*by, "month")
    )


def fill_month_gaps(
    monthly: DataFrame, month: str = "month", value: str = "revenue", by: Sequence[str] = ()
) -> DataFrame:
    """Add the absent months between first and last, within each ``by``, with value 0.

    A month that is present with a null value keeps the null. Each month on
    record brings the absent ones up to the next, so the months are read once.
    Without ``by`` the window sorts one row per month in one task.
    """
    following = F.lead(month).over(Window.partitionBy(*by).orderBy(month))
    last = F.coalesce(F.add_months(following, -1), F.col(month))
    months = F.sequence(month, last, F.make_ym_interval(F.lit(0), F.lit(1)))
    return (
        monthly.select(*by, F.col(month).alias("_on_record"), value, months.alias("_months"))
        .select(*by, F.explode("_months").alias(month), "_on_record", value)
        .withColumn(value, F.when(F.col(month) == F.col("_on_record"), F.col(value)).otherwise(0.0))
        .select(*by, month, value)
        .orderBy(*by, month)
    )
