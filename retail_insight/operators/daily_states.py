"""Figures per day that are kept between loads: a load recomputes the days that it changed.

A day's state holds the parts of its sums and its counts, so daily and monthly
series come from one row a day, equal to those made from all purchases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_insight.functions.clean import month_start
from retail_insight.functions.measures import exact_part, large_part, whole
from retail_insight.operators.overview_scan import with_mean_revenue
from retail_insight.schema import require
from retail_insight.sources.versions import DAY, NO_DAY, current, publish, read_version


def daily_states(df: DataFrame) -> DataFrame:
    """One row per day on record: purchases, and the parts of the sums of amounts and returns."""
    require(df, DAY, "total_amount", "returns")
    return (
        df.where(F.col(DAY).isNotNull())
        .groupBy(DAY)
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum(exact_part("total_amount")).alias("exact"),
            F.sum(large_part("total_amount")).alias("large"),
            F.sum("returns").cast("long").alias("returned"),
            F.count("returns").alias("returns_known"),
        )
    )


def sales_of(states: DataFrame) -> DataFrame:
    """Revenue, order count and 7-row trailing mean revenue per day on record."""
    return with_mean_revenue(states.select(DAY, "exact", "large", "orders"))


def return_rate_of(states: DataFrame) -> DataFrame:
    """Share of returned purchases per day on record."""
    rate = F.col("returned") / F.nullif("returns_known", F.lit(0))
    return states.select(DAY, rate.alias("return_rate")).orderBy(DAY)


def monthly_revenue_of(states: DataFrame) -> DataFrame:
    """Revenue per month on record."""
    revenue = whole(F.sum("exact"), F.sum("large")).alias("revenue")
    return states.groupBy(month_start(F.col(DAY)).alias("month")).agg(revenue).orderBy("month")


def refresh_daily_states(spark: SparkSession, purchases_path: str, states_path: str) -> list[str]:
    """Bring the states at ``states_path`` up to the versioned purchases; returns the days computed.

    Only days whose files changed since the last refresh are read. The states
    themselves, a row a day, are written as a whole; nothing is if no day changed.
    """
    purchases = current(spark, purchases_path)
    if purchases is None:
        raise ValueError(f"no version of a table at {purchases_path}")
    last = current(spark, states_path)
    known = last.note.get("source", {}) if last else {}
    dated = {day: batch for day, batch in purchases.days.items() if day != NO_DAY}
    if "" in dated:
        raise ValueError("the purchases have no folder per day")
    changed = sorted(day for day, batch in dated.items() if known.get(day) != batch)
    stale = changed + sorted(set(known) - set(dated))
    if last is not None and not stale:
        return []
    states = daily_states(read_version(spark, purchases_path, purchases, changed))
    if last is not None:
        days = spark.createDataFrame([(d,) for d in stale], "day string").select(F.col("day").cast("date").alias(DAY))
        kept = read_version(spark, states_path, last).join(F.broadcast(days), DAY, "left_anti")
        states = kept.unionByName(states)
    publish(states.coalesce(1), states_path, note={"source": dated}, by_day=False)
    return changed
