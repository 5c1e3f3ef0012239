"""From raw documents to tokens: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_insight.llm import byte_bpe, simhash
from retail_insight.llm.common import fresh, table
from retail_insight.llm.exact_dedup import exact_dedup
from retail_insight.llm.quality import classify_quality
from retail_insight.llm.source_mix import mix_sources
from retail_insight.sources.workspace import stage


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of each row, and its name; staged, so that the numbers hold."""
    key = fresh(docs, "row_number")
    return stage(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = classify_quality(docs, table(spark, sf_dir, "labels"))
    return scored.where("accepted").select(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, whatever its ids."""
    return exact_dedup(docs, one_row=True).where("kept").select(*docs.columns)


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the first id, or any if none has an id."""
    keyed, key = _keyed(docs)
    gone = simhash.near_duplicates(keyed, row=key).where("NOT first").select(key)
    return keyed.join(gone, key, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, once for every epoch that takes at least half of their words.

    Documents without words take no part in a mix and go. Rows are told apart
    by number: those without an id, or with the same one, have their own share.
    """
    taken, at = fresh(docs, "copies"), fresh(docs, "epoch")
    keyed, key = _keyed(docs)
    plan = mix_sources(keyed, carried=[key]).where("taken * 2 >= size AND size > 0")
    epochs = F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2)).cast("int")
    joined = keyed.join(plan.select(key, epochs.alias(taken)), key)
    return joined.withColumn(at, F.explode(F.sequence(F.lit(1), F.col(taken)))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token numbers of every document, and of their decoding."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.digests(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", keep_distinct),
    ("simhash near-dedup", keep_representatives),
    ("source mix", mix),
    ("byte-level bpe", tokenize),
]

# The classifier is trained and the tokens are made outside SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
