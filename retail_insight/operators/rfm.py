"""Recency, frequency and monetary value per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_insight.functions.measures import recency_days, total
from retail_insight.schema import RFM_INPUT, RFM_METRICS, require


def rfm(df: DataFrame, drop_null_ts: bool = True) -> DataFrame:
    """One row per customer: recency in days, row count, total amount.

    With ``drop_null_ts`` undated purchases are left out, and so are customers
    missing any metric; otherwise undated purchases still count in frequency
    and a customer without any date has null recency.
    """
    require(df, *RFM_INPUT)
    base = df.where(F.col("purchase_ts").isNotNull()) if drop_null_ts else df
    per_customer = base.groupBy("customer_id").agg(
        F.max("purchase_ts").alias("last_purchase"),
        F.count(F.lit(1)).alias("frequency"),
        total("total_amount").alias("monetary"),
    )
    # The newest purchase overall is the newest of the customers' last ones.
    # Carrying all three columns keeps the subquery's shuffle identical to the
    # main one, so the purchases are read and grouped once, not twice.
    newest = per_customer.agg(
        F.max(F.struct("last_purchase", "frequency", "monetary"))["last_purchase"]
    ).scalar()
    result = per_customer.select(
        "customer_id",
        recency_days(newest, F.col("last_purchase")).alias("recency_days"),
        "frequency",
        "monetary",
    )
    return result.na.drop(subset=list(RFM_METRICS)) if drop_null_ts else result
