"""Recommendations: other categories of the same cluster, best sellers first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_insight.operators.lookup import spread_lookup
from retail_insight.operators.sampling import first_per_cluster
from retail_insight.schema import PRODUCT_METRICS, require

COLUMNS = ("product_category", *PRODUCT_METRICS)


def recommend_for(clustered: DataFrame, item: str, k: int = 10) -> DataFrame:
    """The ``k`` best sellers that share the item's cluster, without the item."""
    require(clustered, "prediction", *COLUMNS)
    found = clustered.where(F.col("product_category") == item).select("prediction").first()
    if found is None:
        raise ValueError(f"unknown category: {item}")
    return (
        clustered.where(
            (F.col("prediction") == found["prediction"]) & (F.col("product_category") != item)
        )
        .select(*COLUMNS)
        .orderBy(F.desc("total_revenue"), "product_category")
        .limit(k)
    )


def recommend_all(clustered: DataFrame, k: int = 10) -> DataFrame:
    """``recommend_for`` of every category at once: ``item``, ``rank`` and metrics.

    An item's list is the cluster's best ``k + 1`` without the item itself, so
    only that short list is joined to the items, never the pairs of a cluster.
    """
    require(clustered, "prediction", *COLUMNS)
    order = [F.desc("total_revenue"), F.col("product_category")]
    best = (
        first_per_cluster(clustered.select("prediction", *COLUMNS), order, k + 1, "product_category")
        .groupBy("prediction")
        .agg(F.sort_array(F.collect_list(F.struct("_place", *COLUMNS))).alias("_best"))
    )
    items = clustered.select("prediction", F.col("product_category").alias("item"))
    others = F.filter("_best", lambda b: b["product_category"] != F.col("item"))
    return (
        spread_lookup(items, best, "prediction", "item")
        .select("prediction", "item", F.posexplode(F.slice(others, 1, k)).alias("_at", "_pick"))
        .select(
            "prediction",
            "item",
            (F.col("_at") + 1).alias("rank"),
            *[F.col("_pick")[c].alias(c) for c in COLUMNS],
        )
    )


def browse_cluster(clustered: DataFrame, cluster: int, n: int = 50) -> DataFrame:
    """The cluster's ``n`` best sellers, each row with the count of those not shown."""
    require(clustered, "prediction", *COLUMNS)
    members = clustered.where(F.col("prediction") == cluster).select(*COLUMNS)
    total = members.agg(F.count(F.lit(1))).scalar()
    return (
        members.orderBy(F.desc("total_revenue"), "product_category")
        .limit(n)
        .withColumn("n_more", F.greatest(total - n, F.lit(0)))
    )
