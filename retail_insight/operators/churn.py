"""Churn derived from how long ago a customer last bought."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_insight.functions.measures import recency_days
from retail_insight.schema import has, require
from retail_insight.sources.partitions import sized
from retail_insight.sources.workspace import cut_lineage

# A customer with more rows than one task should take is handled apart. There is
# at most one for so many rows: some 24 MB to broadcast for 10^12 purchases.
HOT_ROWS = 1_000_000
SPREAD = 1024


def customer_activity(df: DataFrame) -> DataFrame:
    """Last purchase and row counts per customer; one row in all without customers.

    ``n_undated`` and ``n_unflagged`` count the rows without a date and without a
    churn flag, so the sums over this table describe the whole input.
    """
    flag = F.col("churn") if has(df, "churn") else F.lit(None)
    keys = ["customer_id"] if has(df, "customer_id") else []
    return df.groupBy(*keys).agg(
        F.max("purchase_ts").alias("last_purchase"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("purchase_ts").isNull()).alias("n_undated"),
        F.count_if(flag.isNull()).alias("n_unflagged"),
    )


def derive_churn(
    df: DataFrame, cutoff_days: int = 180, activity: DataFrame | None = None
) -> DataFrame:
    """Fill null ``churn`` with 1 when the last purchase is over ``cutoff_days`` old.

    Given flags are kept. Rows without a customer stay null, and when no date
    at all is known every null becomes 0. An absent churn column counts as null.
    ``activity`` is ``customer_activity(df)`` when the caller already has it;
    otherwise it is computed now, as it is used several times over.
    """
    require(df, "customer_id", "purchase_ts")
    if not has(df, "churn"):
        df = df.withColumn("churn", F.lit(None).cast("int"))
    activity = cut_lineage(customer_activity(df)) if activity is None else activity
    newest = activity.agg(F.max("last_purchase")).scalar()
    last = activity.select(
        "customer_id",
        F.col("last_purchase").alias("_last"),
        (F.col("n_rows") >= HOT_ROWS).alias("_hot"),
    )
    hot = last.where("_hot").select("customer_id", F.col("_last").alias("_hot_last"), "_hot")
    # Hot customers get their date from the broadcast, so their rows need no
    # partner in the shuffled join: spreading them by map partition keeps every
    # reducer small. Rows without a customer are spread the same way. The far
    # side says -1 for hot customers, as a constant there would be folded away
    # and with it the spreading.
    spread = F.when(
        F.col("_hot") | F.col("customer_id").isNull(), 1 + F.spark_partition_id() % SPREAD
    ).otherwise(0)
    partner = last.select("customer_id", "_last", F.when(F.col("_hot"), -1).otherwise(0).alias("_spread"))
    keys = ["customer_id", "_spread"]
    rows = activity.agg(F.sum("n_rows")).first()[0] or 0
    joined = (
        df.join(F.broadcast(hot), "customer_id", "left")
        .withColumn("_spread", spread)
        .join(sized(partner, rows, *keys), keys, "left")
    )
    days = recency_days(newest, F.coalesce("_hot_last", "_last"))
    derived = F.when(newest.isNull(), 0).otherwise((days > cutoff_days).cast("int"))
    churn = F.coalesce(F.col("churn").cast("int"), derived)
    return joined.withColumn("churn", churn).select(*df.columns)
