"""Equal-width histograms computed by Spark instead of on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_insight.operators.quantiles import trimmed_counts

# Bounds of the automatic bin count.
AUTO_BINS = (10, 40)


def valid_ages(df: DataFrame, column: str = "customer_age") -> DataFrame:
    """Rows with an age strictly between 0 and 100."""
    age = F.col(column).cast("double")
    return df.where((age > 0) & (age < 100))


def histogram(
    df: DataFrame, column: str, bins: int | None = None, weight: str | None = None
) -> DataFrame:
    """``bin``, ``center`` and ``n`` for equal-width bins over min..max.

    The last bin is closed and empty bins are kept. Without ``bins`` the number
    is the square root of the row count, held within ``AUTO_BINS``. ``weight``
    names a count column when ``df`` is already grouped by value.
    """
    if bins is not None and bins < 1:
        raise ValueError("bins must be at least 1")
    values = df.where(F.col(column).isNotNull()).select(
        F.col(column).cast("double").alias("x"),
        (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"),
    )
    low, high = F.min("x"), F.max("x")
    # One repeated value gets a bin range of width one around it.
    pad = F.when(low == high, 0.5).otherwise(0.0)
    auto = F.floor(F.greatest(F.lit(AUTO_BINS[0]), F.least(F.lit(AUTO_BINS[1]), F.sqrt(F.sum("w")))))
    edge = "transform(sequence(0, bins), i -> IF(i = bins, high, low + i * ((high - low) / bins)))"
    shape = (
        values.agg(
            (low - pad).alias("low"),
            (high + pad).alias("high"),
            (F.lit(bins) if bins else auto).cast("int").alias("bins"),
        )
        .where(F.col("low").isNotNull())
        .select(F.struct("low", "high", "bins", F.expr(edge).alias("edges")).alias("s"))
    )
    s = F.col("s")
    # The division may put a value that lies on an edge one bin off, so the
    # guess is checked against the edges themselves.
    guess = F.least(
        F.floor((F.col("x") - s["low"]) * s["bins"] / (s["high"] - s["low"])), s["bins"] - 1
    ).cast("int")
    above = (F.col("x") >= s["edges"][F.col("g") + 1]) & (F.col("g") < s["bins"] - 1)
    below = F.col("x") < s["edges"][F.col("g")]
    counted = (
        values.withColumn("s", shape.scalar())
        .withColumn("g", guess)
        # The bin is never null. Saying so keeps a null check of the join below
        # from being pushed into the scan, where it would undo its reuse.
        .select(
            F.coalesce(
                F.col("g") + F.when(above, 1).when(below, -1).otherwise(0), F.lit(-1)
            ).alias("bin"),
            "w",
        )
        .groupBy("bin")
        .agg(F.sum("w").alias("n"))
    )
    frame = shape.select(
        F.posexplode(
            F.expr("transform(sequence(1, s.bins), i -> (s.edges[i - 1] + s.edges[i]) / 2)")
        ).alias("bin", "center")
    )
    return (
        frame.join(counted, "bin", "left")
        .select("bin", "center", F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy("bin")
    )


def _cell(x: Column, edges: Column, bins: int) -> Column:
    """The bin of a value between the first and last of equally spaced edges, by the edges themselves."""
    guess = F.floor((x - edges[0]) * bins / (edges[bins] - edges[0])).cast("int")
    guess = F.greatest(F.lit(0), F.least(guess, F.lit(bins - 1)))
    above = (guess < bins - 1) & (x >= F.get(edges, guess + 1))
    return guess + F.when(above, 1).when(x < F.get(edges, guess), -1).otherwise(0)


def grid(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """``x_bin``, ``y_bin``, their centres and ``n`` for every cell of an equal-width grid that has rows.

    The form of a scatter that a chart can draw, whatever the number of rows:
    at most ``bins`` squared cells, and every row with both values is in one.
    Edges and the closed last bin are as in ``histogram``; a column of one
    repeated value gets a range of width one around it.
    """
    if bins < 1:
        raise ValueError("bins must be at least 1")
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    )
    bounds = []
    for c in ("x", "y"):
        low, high = F.min(c), F.max(c)
        pad = F.when(low == high, 0.5).otherwise(0.0)
        bounds += [(low - pad).alias(f"{c}_low"), (high + pad).alias(f"{c}_high")]
    edges = F.struct(
        *[
            F.expr(
                f"transform(sequence(0, {bins}), i -> IF(i = {bins}, {c}_high, {c}_low + i * (({c}_high - {c}_low) / {bins})))"
            ).alias(c)
            for c in ("x", "y")
        ]
    )
    placed = both.withColumn("edges", both.agg(*bounds).select(edges).scalar())
    cells = placed.groupBy(
        *[_cell(F.col(c), F.col(f"edges.{c}"), bins).alias(f"{c}_bin") for c in ("x", "y")]
    ).agg(F.count(F.lit(1)).alias("n"), F.first("edges").alias("edges"))
    centre = lambda c: (F.get(F.col(f"edges.{c}"), F.col(f"{c}_bin")) + F.get(F.col(f"edges.{c}"), F.col(f"{c}_bin") + 1)) / 2
    return cells.select(
        "x_bin", "y_bin", centre("x").alias("x_center"), centre("y").alias("y_center"), "n"
    ).orderBy("x_bin", "y_bin")


def age_histogram(df: DataFrame, column: str = "customer_age") -> DataFrame:
    """Automatic-width histogram of the plausible ages, one count per purchase.

    Ages are counted by value first: one pass over the purchases, and only a
    handful of distinct ages goes on to the binning.
    """
    ages = valid_ages(df, column).groupBy(column).agg(F.count(F.lit(1)).alias("purchases"))
    return histogram(ages, column, weight="purchases")


def rfm_distribution(rfm: DataFrame, metric: str, bins: int = 30) -> DataFrame:
    """Histogram of one RFM metric; frequency and monetary lose their top 1 %."""
    if metric == "recency_days":
        return histogram(rfm, metric, bins)
    return histogram(trimmed_counts(rfm, metric, 0.99), "value", bins, weight="n")
