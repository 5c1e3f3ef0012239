"""Reading raw exports, and reading and writing the purchase table."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from retail_insight.schema import RFM_METRICS, has, require


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row, every column as text.

    Types are not inferred: inference reads the file twice and turns number
    text into doubles before it can be cleaned.
    """
    return spark.read.option("header", True).csv(path)


def read_purchases(
    spark: SparkSession,
    path: str,
    start: str | None = None,
    end: str | None = None,
    cache: bool = False,
) -> DataFrame:
    """The purchase table, optionally only the days ``start``..``end``.

    The day range prunes partitions before any file is opened. With ``cache``
    the table is held in memory and on disk after one counting pass.
    """
    df = spark.read.parquet(path)
    if has(df, "purchase_date") and not isinstance(df.schema["purchase_date"].dataType, DateType):
        # Without a single dated row the partition type cannot be told from the folders.
        dated = [
            StructField(f.name, DateType()) if f.name == "purchase_date" else f for f in df.schema
        ]
        df = spark.read.schema(StructType(dated)).parquet(path)
    if start is not None or end is not None:
        require(df, "purchase_date")
    if start is not None:
        df = df.where(F.col("purchase_date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("purchase_date") <= F.lit(end).cast("date"))
    if cache:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        df.count()
    return df


def write_purchases(df: DataFrame, path: str) -> None:
    """Overwrite the purchase table, one folder per day.

    Rebalancing gathers a day's rows into few files of the advisory size and
    splits a day too large for one task, so neither many tiny files nor one
    overloaded writer comes out of a skewed calendar.
    """
    if has(df, "purchase_date"):
        df.hint("rebalance", "purchase_date").write.mode("overwrite").partitionBy(
            "purchase_date"
        ).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    df.sparkSession.catalog.refreshByPath(path)


def default_export_path(purchases_path: str) -> str:
    """Where a segmentation of the table at ``purchases_path`` is exported to."""
    return f"{purchases_path.rstrip('/')}_kmeans_export"


def export_segments(assigned: DataFrame, path: str) -> None:
    """Overwrite the five-column export of a customer segmentation."""
    columns = ("customer_id", *RFM_METRICS, "prediction")
    require(assigned, *columns)
    assigned.select(*columns).write.mode("overwrite").parquet(path)
    assigned.sparkSession.catalog.refreshByPath(path)


def dataset_ready(spark: SparkSession, path: str) -> bool:
    """True when the path holds a readable Parquet table with at least one row."""
    try:
        return not spark.read.parquet(path).isEmpty()
    except (PySparkException, Py4JJavaError):
        return False
