"""Join of a skewed table to a few facts per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WAYS = 64


def spread_lookup(
    df: DataFrame, per_key: DataFrame, key: str, spread_by: str, ways: int = WAYS
) -> DataFrame:
    """Inner join on ``key``, splitting each key's rows over ``ways`` reducers.

    ``per_key`` has one row per key and is repeated ``ways`` times, so a key
    holding a third of ``df`` is still shared out. ``spread_by`` should be close
    to unique within a key. A small ``per_key`` is turned into a broadcast at
    run time, after its size has been measured.
    """
    left = df.withColumn("_way", F.pmod(F.xxhash64(spread_by), F.lit(ways)).cast("int"))
    right = per_key.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return left.join(right, [key, "_way"]).drop("_way")
