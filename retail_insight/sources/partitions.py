"""Shuffled joins whose tasks stay bounded, however few shuffle partitions the session has."""

from __future__ import annotations

from pyspark.sql import DataFrame

# A purchase with all its columns takes some 60 bytes in a shuffle, so these some 70 MB.
ROWS_PER_TASK = 1_200_000


def sized(side: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The smaller side of a join of ``rows`` rows, dealt by ``keys`` to as many tasks as they need.

    Where Spark shuffles the other side, it deals it alike; it may still
    broadcast this one. Nothing is dealt where the shuffle partitions suffice.
    Spark does not split hot keys once a side is dealt: only for keys of which
    none has many rows.
    """
    tasks = -(-rows // ROWS_PER_TASK)
    partitions = int(side.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return side.repartition(tasks, *keys) if tasks > partitions else side
