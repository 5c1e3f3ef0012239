"""Exact quantiles from value counts that are sorted by range.

Equal values are counted first. The counts are sorted over the whole cluster by
ranges of their value, and running counts per range, then within a range, give
each value the ranks it holds. A quantile lies between two ranks, so two values
are picked per quantile. No task holds more than its own range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_insight.sources.workspace import stage


def ranked_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per ``metric`` and distinct ``value``: how often (``n``), how many come ``before``, ``total``.

    Null values do not count. The sorted counts are staged, as their ranges
    have to stay what they are while they are summed up.
    """
    stacked = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
        ).alias("v")
    ).select("v.*")
    counts = stacked.where("value IS NOT NULL").groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"))
    ranges = stage(
        counts.repartitionByRange("metric", "value").withColumn("range", F.spark_partition_id()), "value-counts"
    )
    per_range = ranges.groupBy("metric", "range").agg(F.sum("n").alias("held"))
    whole = Window.partitionBy("metric")
    starts = per_range.select(
        "metric",
        "range",
        F.coalesce(
            F.sum("held").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("start"),
        F.sum("held").over(whole).alias("total"),
    )
    earlier = Window.partitionBy("metric", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranges.withColumn("inner", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(starts, ["metric", "range"])
        .select("metric", "value", "n", (F.col("start") + F.col("inner")).alias("before"), "total")
    )


def _quantile(p: float) -> Column:
    """Aggregate over the ranked values of one metric: linear between the two neighbours of the rank."""
    place = F.lit(float(p)) * (F.col("total") - 1)

    def at(rank: Column) -> Column:
        holds = (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
        return F.max(F.when(holds, F.col("value")))

    low, high = at(F.floor(place)), at(F.ceil(place))
    beyond = F.max(place - F.floor(place))
    return F.when(beyond == 0, low).otherwise((1 - beyond) * low + beyond * high)


def quantiles_of(ranked: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """``metric`` and ``quantiles``, in the order of ``probabilities``, from ``ranked_values``."""
    return ranked.groupBy("metric").agg(F.array(*[_quantile(p) for p in probabilities]).alias("quantiles"))


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> DataFrame:
    """One row holding ``quantiles``, an array in the order of ``probabilities``."""
    ranked = ranked_values(df, [column])
    return ranked.agg(F.array(*[_quantile(p) for p in probabilities]).alias("quantiles"))


def trim_quantile(df: DataFrame, column: str, q: float = 0.99) -> DataFrame:
    """Keep rows at or below the exact ``q`` quantile; null values are dropped."""
    limit = exact_quantiles(df, column, [q]).scalar()
    return df.where(F.col(column) <= limit[0])


def trimmed_counts(df: DataFrame, column: str, q: float) -> DataFrame:
    """``value`` and ``n`` of the values at or below the exact ``q`` quantile."""
    ranked = ranked_values(df, [column])
    limit = ranked.agg(_quantile(q)).scalar()
    return ranked.where(F.col("value") <= limit).select("value", "n")


def describe_metrics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles, one row per metric."""
    base = stage(df.select(*columns), "metrics")
    rows = [
        F.struct(
            F.lit(c).alias("metric"),
            F.count(c).alias("n"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
        )
        for c in columns
    ]
    plain = base.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    quartiles = quantiles_of(ranked_values(base, columns), [0.25, 0.5, 0.75])
    return plain.join(quartiles, "metric", "left").select(
        "metric",
        "n",
        "mean",
        "std",
        "min",
        *[F.col("quantiles")[i].alias(name) for i, name in enumerate(("p25", "p50", "p75"))],
        "max",
    )
