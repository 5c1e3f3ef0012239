"""Samples that do not depend on how the rows are laid out.

Membership is decided by a hash of the row's key, so the same rows are chosen
after a retry, on another cluster size, or in another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_insight.operators.lookup import WAYS

# Fixed value: default seed of every sample and model.
SEED = 42


def unit_hash(key: str, seed: int = SEED) -> Column:
    """Key mapped to a number in [0, 1), spread evenly."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def hash_sample(df: DataFrame, fraction: float, key: str, seed: int = SEED) -> DataFrame:
    """About ``fraction`` of the rows, those whose key hashes below it."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie between 0 and 1")
    return df.where(unit_hash(key, seed) < F.lit(float(fraction)))


def cluster_examples(
    clustered: DataFrame, n: int = 3, key: str = "product_category", seed: int = SEED
) -> DataFrame:
    """At most ``n`` members per cluster, as chart labels.

    Ranked in parts of a cluster first, then among the best of each part, so
    that no task ever holds a whole cluster, whatever ``n``.
    """
    return first_per_cluster(clustered, [unit_hash(key, seed), F.col(key)], n, key).drop("_place")


def first_per_cluster(df: DataFrame, order: list[Column], n: int, key: str, ways: int = WAYS) -> DataFrame:
    """The first ``n`` rows of each ``prediction`` with their ``_place``, ranked in two stages."""
    part = F.pmod(F.xxhash64(key), F.lit(ways))
    within = Window.partitionBy("prediction", "_part").orderBy(*order)
    overall = Window.partitionBy("prediction").orderBy(*order)
    best = (
        df.withColumn("_part", part)
        .withColumn("_place", F.row_number().over(within))
        .where(F.col("_place") <= n)
    )
    return (
        best.withColumn("_place", F.row_number().over(overall)).where(F.col("_place") <= n).drop("_part")
    )
