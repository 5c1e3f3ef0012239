"""Expressions and joins that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spark's regular expressions read these as in Java: runs free of ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SALTS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does just that where a text is all ASCII."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(ascii_only, F.lower(text)).otherwise(folded)


def whole(text: str) -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name near ``name`` that ``df`` does not use, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], by: str, salts: int = SALTS
) -> DataFrame:
    """``rows`` inner-joined to ``lookup``, which has one row per key.

    A key may hold a third of all rows, so the rows of a key are dealt by the
    hash of ``by`` over ``salts`` join keys; the lookup is copied only to the
    salts that occur, hence at most ``salts`` times and never more often than
    the key has rows. Keys must not be null.
    """
    salt = fresh(rows, "salt")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    fan = salted.select(*keys, salt).distinct().join(lookup, keys)
    return salted.join(fan, [*keys, salt]).drop(salt)
