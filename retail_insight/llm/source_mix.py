"""Mixing sources to target weights by hash order and distributed prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retail_insight.llm.common import WORD, whole
from retail_insight.sources.workspace import stage

WEIGHTS = (5, 2, 1)
ROWS_PER_RANGE = 2_000
RANGES_PER_SPAN = 1_024


def _targets(sources: DataFrame, weights: Sequence[int], share: float, epochs: int) -> DataFrame:
    """``target`` per source: its weight's share of the budget, at most ``epochs`` times its size.

    What a full source leaves over goes to the others by weight. Ordered by
    size over weight, the full sources come first; the level of the rest is
    what remains of the budget over the weights that remain. The rows are one
    per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighed = sources.withColumn("place", F.row_number().over(order)).withColumn(
        "weight", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    )
    fullness = [F.col("source_size") / F.col("weight"), F.col("place")]
    before = Window.orderBy(*fullness).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*fullness).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(*fullness).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.col("source_size") * epochs
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share))
        - F.coalesce(F.sum("source_size").over(before) * epochs, F.lit(0))
    ) / F.sum("weight").over(rest)
    levelled = weighed.withColumn("level", level)
    # The first source that is not full sets the level for all after it.
    ordered = levelled.withColumn("turn", F.row_number().over(Window.orderBy(*fullness)))
    not_full = F.when(full > F.col("level") * F.col("weight"), F.struct("turn", "level"))
    open_level = F.min(not_full).over(everything)["level"]
    share_of = F.coalesce(open_level * F.col("weight"), full.cast("double"))
    return ordered.select(
        "source", "source_size", F.least(full.cast("double"), share_of).alias("target")
    )


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.5,
    epochs: int = 2,
    seed: int = 7,
    carried: Sequence[str] = (),
) -> DataFrame:
    """One row per document: ``size`` in words, ``source_size``, ``target`` and ``taken``.

    Sources by code point, null last, take the weights in turn and share
    ``share`` times all words; none takes more than ``epochs`` times its own.
    Documents are put in the order of a hash of id and text within each
    source; every epoch takes from the start, and the last one stops at the
    word where the target is met, so a source's ``taken`` add up to its target
    rounded down. A null or empty text has size 0 and takes nothing. Equal rows
    are told apart by the ``carried`` columns, which come out too, and by their
    place in the order. No rows give no rows.

    The hash order is cut into ranges of equal width, as many as the table has
    ``ROWS_PER_RANGE`` rows, so that a source with a third of all documents is
    dealt over many tasks; spans of ranges, ranges, then the rows within a
    range, are summed up to prefix sums.
    """
    sized = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.regexp_count(whole(text), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(doc_id), whole(text)).alias("place"),
        *carried,
    )
    ranges = docs.count() // ROWS_PER_RANGE + 1
    high = F.shiftrightunsigned("place", 33)  # 31 bits, evenly spread
    sized = stage(sized.withColumn("cut", F.shiftright(high * F.lit(ranges), 31)), "sized")
    totals = sized.groupBy("source", "cut").agg(F.sum("size").alias("words"))
    sources = totals.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = _targets(sources, weights, share, epochs)
    # Prefix sums of the range totals: over the ranges of a span, and over the spans of a source.
    spanned = totals.withColumn("span", F.floor(F.col("cut") / RANGES_PER_SPAN))
    spans = spanned.groupBy("source", "span").agg(F.sum("words").alias("span_words"))
    above = Window.partitionBy("of").orderBy("in_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        spans.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .select("of", F.col("span").alias("in_span"), "span_words", "source_size", "target")
        .withColumn("start", F.coalesce(F.sum("span_words").over(above), F.lit(0)))
    )
    earlier = Window.partitionBy("source", "span").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        spanned.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("span") == F.col("in_span")))
        .select(
            "of",
            F.col("cut").alias("at"),
            (F.col("start") + F.col("before")).alias("offset"),
            "source_size",
            "target",
        )
    )
    within = (
        Window.partitionBy("source", "cut")
        .orderBy(high, "place", "doc_id", *carried)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    running = sized.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = running.join(
        plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("cut") == F.col("at"))
    )
    budget = F.floor("target")
    rounds = F.expr("CASE WHEN source_size > 0 THEN floor(target) DIV source_size ELSE 0 END")
    left = budget - rounds * F.col("source_size") - F.col("offset") - F.col("inner")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *carried)
