"""Customer segments: clustering on RFM, cluster profiles and their labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_insight.operators.clustering import (
    ROWS_PER_TASK,
    Choice,
    features,
    fit_scaler,
    select_k,
    training_rows,
)
from retail_insight.operators.sampling import SEED
from retail_insight.schema import RFM_METRICS, require
from retail_insight.sources.workspace import cut_lineage

# The k tried, and the rows of a detail table.
CUSTOMER_KS = tuple(range(2, 9))
DETAIL_ROWS = 200


@dataclass
class Segments:
    """``assigned`` holds every customer with ``features`` and ``prediction``."""

    choice: Choice
    assigned: DataFrame

    @property
    def scores(self) -> DataFrame:
        return self.choice.scores(self.assigned)


def segment_customers(
    rfm: DataFrame,
    ks: Sequence[int] = CUSTOMER_KS,
    seed: int = SEED,
    rows_per_task: int = ROWS_PER_TASK,
) -> Segments:
    """Cluster customers on scaled RFM, choosing k by silhouette.

    The scaler, every model tried and every silhouette see all customers.
    ``rows_per_task`` is the size of a training task.
    """
    require(rfm, "customer_id", *RFM_METRICS)
    # Dozens of jobs follow, so the purchases behind the table are read once only.
    rfm = cut_lineage(rfm.na.drop(subset=list(RFM_METRICS)))
    total = rfm.count()
    if total == 0:
        raise ValueError("no usable rows: customers with recency, frequency and monetary value")
    scaler = fit_scaler(rfm, RFM_METRICS, with_mean=False)
    everyone = scaler.transform(features(rfm, RFM_METRICS))
    scaled = training_rows(everyone, "customer_id", total, rows_per_task)
    try:
        choice = select_k(scaled, ks, seed=seed)
    finally:
        scaled.unpersist()
    return Segments(choice, choice.model.transform(everyone))


def global_averages(rfm: DataFrame) -> DataFrame:
    """Mean recency, frequency and monetary value over all customers, null as 0."""
    return rfm.agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"global_{m}") for m in RFM_METRICS])


def cluster_profile(assigned: DataFrame) -> DataFrame:
    """Averages and size per cluster, with the difference to the overall averages."""
    overall = global_averages(assigned).select(F.struct("*")).scalar()
    return (
        assigned.groupBy("prediction")
        .agg(
            F.avg("recency_days").alias("avg_recency"),
            F.avg("frequency").alias("avg_freq"),
            F.avg("monetary").alias("avg_monetary"),
            F.count(F.lit(1)).alias("n_customers"),
        )
        .withColumn("overall", overall)
        .select(
            "prediction",
            "avg_recency",
            "avg_freq",
            "avg_monetary",
            "n_customers",
            F.col("overall.global_recency_days").alias("global_recency"),
            F.col("overall.global_frequency").alias("global_freq"),
            F.col("overall.global_monetary").alias("global_monetary"),
        )
        .withColumn("delta_recency", F.col("avg_recency") - F.col("global_recency"))
        .withColumn("delta_freq", F.col("avg_freq") - F.col("global_freq"))
        .withColumn("delta_monetary", F.col("avg_monetary") - F.col("global_monetary"))
        .orderBy("prediction")
    )


# How far from the overall mean counts as low or high.
LOW, HIGH = 0.9, 1.1


def cluster_label(
    recency: Column, frequency: Column, monetary: Column, g_r: Column, g_f: Column, g_m: Column
) -> Column:
    """Segment name from a cluster's averages against the overall ones."""

    def low(value, mean):
        return value < mean * LOW

    def high(value, mean):
        return value > mean * HIGH

    # The rules in order of precedence.
    return (
        F.when(low(recency, g_r) & high(frequency, g_f) & high(monetary, g_m), "vip")
        .when(high(recency, g_r) & low(frequency, g_f), "at_risk")
        .when(low(recency, g_r) & low(frequency, g_f), "new")
        .when(high(frequency, g_f), "loyal")
        .when(high(monetary, g_m), "big_spender")
        .when(high(recency, g_r), "dormant")
        .otherwise("average")
    )


def label_clusters(profile: DataFrame) -> DataFrame:
    """Add ``label`` to the rows of ``cluster_profile``."""
    columns = (
        "avg_recency",
        "avg_freq",
        "avg_monetary",
        "global_recency",
        "global_freq",
        "global_monetary",
    )
    return profile.withColumn("label", cluster_label(*[F.col(c) for c in columns]))


def segment_detail(assigned: DataFrame, n: int = DETAIL_ROWS) -> DataFrame:
    """First ``n`` customers in order of cluster and id."""
    return (
        assigned.select("customer_id", *RFM_METRICS, "prediction")
        .orderBy("prediction", "customer_id")
        .limit(n)
    )


def scatter(assigned: DataFrame) -> DataFrame:
    """Every customer's metrics for a chart, cluster id as text for colouring.

    A chart that cannot show them all takes ``hash_sample`` or ``histogram.grid``.
    """
    return assigned.select(
        *RFM_METRICS, F.col("prediction").cast("string").alias("prediction")
    )
