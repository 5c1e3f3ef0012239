"""Aggregate expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Sums are kept to a millionth, so that they do not depend on the order of the rows;
# amounts from here on leave no room for that and are summed as they are.
EXACT = "decimal(28,6)"
LARGE = 1e21


def exact_part(name: str) -> Column:
    """A number as a decimal, null if it is too large for one."""
    return F.when(F.abs(F.col(name)) < LARGE, F.col(name).try_cast(EXACT))


def large_part(name: str) -> Column:
    """A number too large for a decimal (or none at all: infinite, NaN) as a double, else null."""
    value = F.col(name).cast("double")
    return F.when(F.abs(value) >= LARGE, value)


def whole(exact: Column, large: Column) -> Column:
    """The sum of both parts as a double; null only if both are."""
    exact = exact.cast("double")
    return F.coalesce(exact + large, exact, large)


def total(name: str) -> Column:
    """Sum of a number column as a double: exact for amounts below ``LARGE``, whatever the order.

    Larger ones, such as a damaged export may hold, join as doubles and cannot
    stop a report; one infinite or NaN amount makes the sum so.
    """
    return whole(F.sum(exact_part(name)), F.sum(large_part(name)))


def average(name: str) -> Column:
    """Mean as exact sum over count."""
    return total(name) / F.count(name)


def null_ratio(name: str) -> Column:
    """Share of rows in which the column is null; null when there are no rows."""
    return F.avg(F.col(name).isNull().cast("int"))


def percent(ratio: Column) -> Column:
    """Ratio to percent with two decimals; no data counts as zero."""
    return F.round(F.coalesce(ratio, F.lit(0.0)) * 100, 2)


def recency_days(newest: Column, last: Column) -> Column:
    """Whole calendar days from the last purchase to the newest one on record."""
    return F.datediff(newest, last)
