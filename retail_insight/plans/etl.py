"""Messy purchase export to the typed, cleaned, date-partitioned table."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from retail_insight.functions import clean
from retail_insight.functions.measures import null_ratio
from retail_insight.operators.churn import derive_churn
from retail_insight.schema import CATEGORICAL, has, require
from retail_insight.sources.tables import read_raw, write_purchases
from retail_insight.sources.versions import publish, replace_days
from retail_insight.sources.workspace import stage

# Share of unknown churn above which it is derived, and share of
# unreadable dates from which the export is reported as unparseable.
CHURN_FILL_ABOVE = 0.5
DATES_UNREADABLE_FROM = 0.9999
CHURN_CUTOFF_DAYS = 180


def typed_purchases(
    raw: DataFrame,
    ts_format: str | None = None,
    mode: str = "strict",
    parens_negative: bool = False,
) -> DataFrame:
    """Canonical names and types, row by row; absent columns stay absent.

    ``purchase_ts`` and ``purchase_date`` always exist, null without a date
    column. ``customer_id`` stays text, since its type depends on all of it.
    """
    df = clean.normalize_columns(raw)
    typed = {
        "customer_age": lambda c: c.try_cast("double"),
        "product_price": lambda c: clean.clean_money(c, parens_negative),
        "total_amount": lambda c: clean.clean_money(c, parens_negative),
        "quantity": clean.clean_int,
        "returns": clean.clean_flag,
        "churn": clean.clean_flag,
        "customer_id": lambda c: F.trim(c.cast("string")),
        "purchase_date_raw": clean.normalize_ts_text,
    }
    df = df.withColumns({c: rule(F.col(c)) for c, rule in typed.items() if has(df, c)})
    if has(df, "purchase_date_raw"):
        df = df.withColumn("_text", F.trim("purchase_date_raw"))
        ts = clean.parse_event_time(F.col("_text"), ts_format, mode)
    else:
        ts = F.lit(None).cast("timestamp")
    df = df.withColumn("purchase_ts", ts).drop("_text")
    return df.withColumn("purchase_date", clean.event_date(F.col("purchase_ts")))


def parse_quality(df: DataFrame) -> DataFrame:
    """Row count and share of rows without a readable date, as one row."""
    require(df, "purchase_ts")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), null_ratio("purchase_ts").alias("ts_null_ratio")
    )


def whole_table_facts(typed: DataFrame) -> Row:
    """What only the whole table can tell: null shares of date and churn, id type."""
    whole = F.lit(False)
    if has(typed, "customer_id"):
        ids = F.col("customer_id")
        whole = F.count(ids) == F.count(ids.try_cast("long"))
    churn_nulls = null_ratio("churn") if has(typed, "churn") else F.lit(None).cast("double")
    return typed.agg(
        null_ratio("purchase_ts").alias("ts_nulls"),
        churn_nulls.alias("churn_nulls"),
        whole.alias("whole_ids"),
    ).first()


def etl(
    raw: DataFrame,
    ts_format: str | None = None,
    mode: str = "strict",
    parens_negative: bool = False,
) -> DataFrame:
    """Raw export to purchases, as a DataFrame.

    The one pass over the raw rows runs now and leaves the typed table in the
    shared folder. Whole-table decisions come from its counters: whether ids are
    numbers, so that ``7``, ``07`` and `` 7`` are one customer before anything is
    grouped, and whether churn has to be derived.
    """
    typed = stage(typed_purchases(raw, ts_format, mode, parens_negative), "typed-purchases")
    known = whole_table_facts(typed)
    if known["ts_nulls"] is not None and known["ts_nulls"] >= DATES_UNREADABLE_FROM:
        warnings.warn("no purchase date could be read; check the date format", stacklevel=2)
    if known["whole_ids"]:
        typed = typed.withColumn("customer_id", F.col("customer_id").try_cast("long"))
    if known["churn_nulls"] is None or known["churn_nulls"] > CHURN_FILL_ABOVE:
        typed = derive_churn(typed, CHURN_CUTOFF_DAYS)
    return clean.fill_unknown(typed, CATEGORICAL)


def run_etl(
    spark: SparkSession,
    src: str,
    dst: str,
    ts_format: str | None = None,
    mode: str = "strict",
    parens_negative: bool = False,
) -> str:
    """CSV export at ``src`` to the purchase table at ``dst``; returns ``dst``."""
    write_purchases(etl(read_raw(spark, src), ts_format, mode, parens_negative), dst)
    return dst


def reload_etl(
    spark: SparkSession,
    src: str,
    dst: str,
    ts_format: str | None = None,
    mode: str = "strict",
    parens_negative: bool = False,
    days_only: bool = False,
) -> int:
    """CSV export at ``src`` into the versioned table at ``dst``, which stays readable; returns the version.

    With ``days_only`` the export replaces the days that it has rows of, and the
    rest of the table stays. Unknown churn is derived from the export alone, so
    an export of some days should bring its own.
    """
    df = etl(read_raw(spark, src), ts_format, mode, parens_negative)
    return (replace_days if days_only else publish)(df, dst).number
