"""The whole overview from one scan of the purchases.

Every breakdown is one set of a single grouping, so the purchases are read and
combined in the map tasks once for all of them. What remains are the breakdowns'
states: sums and counts per day, category, payment, gender and age, and the
number of customers. They are small, whatever the number of purchases.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_insight.functions.measures import exact_part, large_part, percent, whole
from retail_insight.operators.histogram import histogram, valid_ages
from retail_insight.operators.series import moving_average
from retail_insight.schema import has
from retail_insight.sources.workspace import stage

# Breakdown by column; customers are only counted, so their ids are not kept.
COUNTED = "customer_id"
KEPT = ("purchase_date", "product_category", "payment_method", "gender", "customer_age")
MEASURES = ("total_amount", "returns", "churn")
KPI_COLUMNS = (COUNTED, "product_category", *MEASURES)


def _sums(measure: str) -> dict[str, Column]:
    """The parts of a measure's sum by name; amounts have an exact and a large one."""
    if measure != "total_amount":
        return {f"{measure}_sum": F.sum(measure)}
    return {f"{measure}_sum": F.sum(exact_part(measure)), f"{measure}_large": F.sum(large_part(measure))}


def with_mean_revenue(daily: DataFrame) -> DataFrame:
    """Days in order with revenue, orders and the 7-row trailing mean, from the parts of the sums."""
    moved = moving_average(daily, "exact", "purchase_date", rows=7, name="rev_ma7", large="large")
    revenue = whole(F.col("exact"), F.col("large")).alias("revenue")
    return moved.select("purchase_date", revenue, "orders", "rev_ma7").orderBy("purchase_date")


def overview_states(df: DataFrame) -> DataFrame:
    """One row for each ``breakdown`` and value, and one for all customers.

    Columns: the breakdown's column by name, its value under that name, the
    number of purchases ``n``, ``groups`` (how many values that are not null
    the row stands for) and, per measure, its sum and count. A purchase counts
    once in every breakdown, under null if it has no value there.
    """
    keys = [c for c in (*KEPT, COUNTED) if has(df, c)]
    measures = [c for c in MEASURES if has(df, c)]
    parts = {name: column for c in measures for name, column in _sums(c).items()}
    sums = [column.alias(name) for name, column in parts.items()]
    counts = [F.count(c).alias(f"{c}_n") for c in measures]
    n = F.count(F.lit(1)).alias("n")
    if not keys:
        return df.agg(n, *sums, *counts).select(F.lit(None).cast("string").alias("breakdown"), F.lit(0).cast("long").alias("groups"), "*")
    # Of the columns' bits in the grouping id only that of the set's own column is 0.
    every = (1 << len(keys)) - 1
    place = F.grouping_id(*keys)
    name = F.lit(None).cast("string")
    for k, c in enumerate(reversed(keys)):
        name = F.when(place == every ^ (1 << k), c).otherwise(name)
    split = df.groupingSets([[F.col(c)] for c in keys], *keys).agg(name.alias("breakdown"), n, *sums, *counts)
    kept = [c for c in keys if c != COUNTED]
    known = F.coalesce(*[F.col(c).cast("string") for c in keys]).isNotNull()
    return split.groupBy("breakdown", *kept).agg(
        F.sum(known.cast("long")).alias("groups"),
        *[F.sum(c).alias(c) for c in ("n", *parts, *[f"{m}_n" for m in measures])],
    )


@dataclass
class Overview:
    """The parts of an overview, all from the same staged states; a part whose columns are absent raises."""

    states: DataFrame
    columns: list[str]

    def _by(self, *columns: str) -> DataFrame:
        missing = [c for c in columns if c not in self.columns]
        if missing:
            raise ValueError(f"missing required columns: {', '.join(missing)}")
        return self.states.where(F.col("breakdown") == columns[0])

    def _total(self, column: str) -> Column:
        """Over all purchases: the sum over any one breakdown, here that of fewest rows to add."""
        first = next((c for c in (COUNTED, *KEPT) if c in self.columns), None)
        return F.sum(column if first is None else F.when(F.col("breakdown") == first, F.col(column)))

    def _measures(self, count: str = "cnt") -> list[Column]:
        revenue = whole(F.col("total_amount_sum"), F.col("total_amount_large")) if "total_amount" in self.columns else None
        return [F.col("n").alias(count), *([] if revenue is None else [revenue.alias("revenue")])]

    def summary(self) -> DataFrame:
        """Row count, column count and column names, as one row."""
        return self.states.agg(F.coalesce(self._total("n"), F.lit(0)).alias("row_count")).select(
            "row_count",
            F.lit(len(self.columns)).alias("column_count"),
            F.array(*[F.lit(c) for c in self.columns]).alias("columns"),
        )

    def kpis(self) -> DataFrame:
        """Customers, categories, revenue, return and churn percent."""
        values = lambda c: F.coalesce(F.sum(F.when(F.col("breakdown") == c, F.col("groups"))), F.lit(0))
        rate = lambda c: percent(self._total(f"{c}_sum").cast("double") / F.nullif(self._total(f"{c}_n"), F.lit(0)))
        figures = {
            COUNTED: ("customers", lambda: values(COUNTED)),
            "product_category": ("categories", lambda: values("product_category")),
            "total_amount": ("revenue", lambda: whole(self._total("total_amount_sum"), self._total("total_amount_large"))),
            "returns": ("return_rate_pct", lambda: rate("returns")),
            "churn": ("churn_rate_pct", lambda: rate("churn")),
        }
        present = [figure().alias(name) for c, (name, figure) in figures.items() if c in self.columns]
        if not present:
            raise ValueError("no KPI column is present")
        return self.states.agg(*present)

    def daily_sales(self) -> DataFrame:
        """Revenue, order count and 7-row trailing mean revenue per day on record."""
        days = self._by("purchase_date", "total_amount").where(F.col("purchase_date").isNotNull())
        parts = [F.col("total_amount_sum").alias("exact"), F.col("total_amount_large").alias("large")]
        return with_mean_revenue(days.select("purchase_date", *parts, F.col("n").alias("orders")))

    def top_categories(self, by: str = "cnt", n: int = 10) -> DataFrame:
        """The ``n`` largest categories by ``cnt`` or ``revenue``, ties by name."""
        needed = ["product_category"] + ["total_amount"] * (by == "revenue")
        found = self._by(*needed).select("product_category", *self._measures())
        return found.orderBy(F.desc(by), "product_category").limit(n)

    def payment_mix(self) -> DataFrame:
        """Orders and revenue per payment method, most used first."""
        found = self._by("payment_method").select("payment_method", *self._measures())
        return found.orderBy(F.desc("cnt"), "payment_method")

    def _average(self, measure: str) -> Column:
        return F.col(f"{measure}_sum").cast("double") / F.nullif(F.col(f"{measure}_n"), F.lit(0))

    def daily_return_rate(self) -> DataFrame:
        """Share of returned purchases per day on record."""
        days = self._by("purchase_date", "returns").where(F.col("purchase_date").isNotNull())
        return days.select("purchase_date", self._average("returns").alias("return_rate")).orderBy("purchase_date")

    def churn_by_gender(self) -> DataFrame:
        """Share of churned purchases per gender; unknown churn does not count."""
        return self._by("gender", "churn").select("gender", self._average("churn").alias("churn_rate")).orderBy("gender")

    def age_histogram(self) -> DataFrame:
        """Automatic-width histogram of the plausible ages, one count per purchase."""
        return histogram(valid_ages(self._by("customer_age")), "customer_age", weight="n")


def overview_of(df: DataFrame) -> Overview:
    """Scan the purchases once and stage the states that all parts are made of."""
    return Overview(stage(overview_states(df), "overview"), df.columns)
