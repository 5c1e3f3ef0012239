"""Exact deduplication: two passes over a Bloom filter, then a shuffle of the few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_insight.llm.common import ascii_lower, fresh, spread_join, whole
from retail_insight.sources.workspace import stage

BLOCK_BITS = 32_768  # of a bitmap as Spark's bitmap functions build it
ADDED = ("text_sha256", "keep_id", "group_size", "kept")


def _is_set(bitmap: str, position: str) -> Column:
    return F.expr(
        f"shiftright(CAST(conv(hex(substring({bitmap}, CAST({position} DIV 8 AS INT) + 1, 1)), 16, 10)"
        f" AS INT), CAST({position} % 8 AS INT)) & 1 = 1"
    )


def exact_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    bits_per_row: int = 16,
    max_filter_bits: int = 1 << 30,
    one_row: bool = False,
) -> DataFrame:
    """Every row of ``docs`` with the document that stays for its text.

    Adds ``text_sha256`` of the text with A-Z lower-cased, ``keep_id`` (the
    largest id of an equal text), ``group_size`` and ``kept``. A null text
    counts as empty; empty texts equal each other. Rows that repeat an id
    share its fate, and count towards the size. A null id never wins over
    another; where all ids of a text are null, all its rows are kept. With
    ``one_row`` just one row of each text is kept, also of those that repeat
    ``keep_id`` or have no id. An input column named like an added one is
    replaced. An empty table gives no rows.

    Pass one counts, for two bit positions of each hash, how many rows hit
    them; positions hit twice make the filter. Pass two probes every row: a
    repeated text always finds both its bits, so a row that does not is unique
    and goes straight through. Only the others are shuffled, dealt by a salt
    within each text. The filter is the one broadcast: at most
    ``max_filter_bits`` (128 MB), whatever the input; a fuller filter lets
    more unique rows through to the exact stage, and never changes the result.
    """
    for name in ADDED:
        docs = docs.drop(*[c for c in docs.columns if c.lower() == name])
    block, low, high, maybe = (fresh(docs, c) for c in ("bloom_block", "bloom_low", "bloom_high", "bloom_hit"))
    blocks = min(max(docs.count() * bits_per_row, BLOCK_BITS), max_filter_bits) // BLOCK_BITS
    digest = F.sha2(ascii_lower(whole(text)), 256)
    hashed = docs.withColumn("text_sha256", digest).withColumns(
        {
            block: F.pmod(F.xxhash64("text_sha256", F.lit(1)), F.lit(blocks)).cast("int"),
            low: F.pmod(F.xxhash64("text_sha256", F.lit(2)), F.lit(BLOCK_BITS)),
            high: F.pmod(F.xxhash64("text_sha256", F.lit(3)), F.lit(BLOCK_BITS)),
        }
    )
    positions = hashed.select(block, F.explode(F.array_distinct(F.array(low, high))).alias("bit"))
    hit_twice = positions.groupBy(block, "bit").agg(F.count("*").alias("hits")).where("hits > 1")
    repeated = fresh(docs, "bloom_bits")
    bloom = stage(
        hit_twice.repartition(block)
        .groupBy(block)
        .agg(F.bitmap_construct_agg(F.col("bit")).alias(repeated)),
        "bloom",
    )
    probed = hashed.join(F.broadcast(bloom), block, "left").withColumn(
        maybe, F.coalesce(_is_set(repeated, low) & _is_set(repeated, high), F.lit(False))
    )
    columns = [*docs.columns, "text_sha256"]
    once = probed.where(~F.col(maybe)).select(
        *columns,
        F.col(doc_id).alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
    )
    row, keep_row = fresh(docs, "row_number"), fresh(docs, "keep_row")
    others = stage(
        probed.where(maybe).select(*columns, *[F.monotonically_increasing_id().alias(row)] * one_row),
        "possibly-repeated",
    )
    best, is_best = F.max(doc_id), F.col(doc_id).eqNullSafe(F.col("keep_id"))
    if one_row:
        best = F.max(F.struct(F.col(doc_id).alias("id"), (-F.col(row)).alias("row")))
        is_best = F.col(row) == F.col(keep_row)
    groups = others.groupBy("text_sha256").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    if one_row:
        groups = groups.select(
            "text_sha256", F.col("keep_id.id").alias("keep_id"), (-F.col("keep_id.row")).alias(keep_row), "group_size"
        )
    matched = spread_join(others, groups, ["text_sha256"], by=row if one_row else doc_id).select(
        *columns, "keep_id", "group_size", is_best.alias("kept")
    )
    return once.unionByName(matched)
