"""Shared storage for results that must outlive the executors that made them."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; without it, one beside the warehouse tables.

    Both are reachable by the driver and by every executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else uses, removed by ``release``."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back.

    What follows restarts from the files, so a lost executor costs no
    recomputation of what came before.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, column: str, buckets: int, label: str = "bucketed") -> DataFrame:
    """Like ``stage``, in buckets by a column: joins on it need not shuffle these rows again.

    There are at least as many buckets as shuffle partitions; with fewer, the
    planner would shuffle the bucketed side too. There are at most as many as
    the session allows (``spark.sql.sources.bucketing.maxBuckets``): beyond
    that a bucket grows with the data, and the session may allow more.
    """
    spark = df.sparkSession
    buckets = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    path = new_path(spark, label)
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    _tables.append(name)
    df.write.bucketBy(buckets, column).option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Like ``stage``: columnar, prunable, with sizes that the planner can use."""
    return stage(df)


def release(spark: SparkSession) -> None:
    """Delete every stage of this process; call it when no result in use reads one."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if _made and spark is not None and spark.sparkContext._jsc is not None:
        release(spark)
