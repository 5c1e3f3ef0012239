"""Positions and running sums of rows in a global order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retail_insight.llm.common import fresh
from retail_insight.sources.workspace import stage


def ranked(df: DataFrame, group: str, by: list[str], weight: str | None = None) -> DataFrame:
    """``df`` with ``position``, ``group_rows`` and, with a weight, ``before`` and ``group_weight``.

    ``position`` counts the rows of the same ``group`` that come earlier in the
    order of ``by`` (nulls first); ``before`` sums their weights. Rows are
    sorted by range over the cluster, so a group of any size is spread over
    many tasks; each task numbers its own part, and the parts' totals, one row
    for each part and group, give the offsets. ``group`` must not be null, and
    ``by`` should end in a column that tells equal rows apart, so that a run of
    them can be split. ``df`` should be narrow and staged: the ranges are
    chosen by a sample of it.
    """
    part, at = fresh(df, "part"), fresh(df, "at")
    amount = F.col(weight) if weight else F.lit(0).cast("long")
    held = fresh(df, "amount")
    ordered = (
        df.withColumn(held, amount)
        .repartitionByRange(group, *by)
        .sortWithinPartitions(group, *by)
        .withColumn(part, F.spark_partition_id())
        .withColumn(at, F.monotonically_increasing_id())
    )
    ordered = stage(ordered, "ordered")
    own = Window.partitionBy(part, group).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = ordered.withColumns(
        {
            "position": F.row_number().over(own).cast("long") - 1,
            "before": F.coalesce(F.sum(held).over(own), F.lit(0)) - F.coalesce(held, F.lit(0)),
        }
    )
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    parts = (
        ordered.groupBy(part, group)
        .agg(F.count(F.lit(1)).alias("rows_"), F.coalesce(F.sum(held), F.lit(0)).alias("sum_"))
        .select(
            part,
            group,
            F.coalesce(F.sum("rows_").over(earlier), F.lit(0)).alias("rows_before_"),
            F.coalesce(F.sum("sum_").over(earlier), F.lit(0)).alias("sum_before_"),
            F.sum("rows_").over(whole).alias("group_rows"),
            F.sum("sum_").over(whole).alias("group_weight"),
        )
    )
    found = (
        numbered.join(parts, [part, group])
        .withColumn("position", F.col("position") + F.col("rows_before_"))
        .withColumn("before", F.col("before") + F.col("sum_before_"))
        .drop(part, at, held, "rows_before_", "sum_before_")
    )
    return found if weight else found.drop("before", "group_weight")
