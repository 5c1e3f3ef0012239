"""Token counts by a map-side lookup in two tiers; no pre-token is shuffled."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_CHARS = 500_000  # of text whose pre-tokens are held at once
TASK_WORDS = 4_096  # frequent pre-tokens that a task reports
CACHE_WORDS = 300_000  # misses that a worker remembers


def _pieces(texts: pa.Array) -> Iterator[list[str]]:
    """Runs of whole texts of about PIECE_CHARS; nulls as empty."""
    held, chars = [], 0
    for value in texts:
        held.append(value.as_py() or "")
        chars += len(held[-1])
        if chars >= PIECE_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def frequent_words(docs: DataFrame, text: str, pattern: str, size: int) -> list[str]:
    """About the ``size`` most frequent pre-tokens of all texts.

    Each task counts all its pre-tokens, dropping the rarest when it holds too
    many, and reports its ``TASK_WORDS`` most frequent; only these meet.
    Which words are chosen changes the speed of a count, never its value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = regex.compile(pattern).findall, Counter()
        for batch in batches:
            for texts in _pieces(batch.column(0)):
                for value in texts:
                    seen.update(split(value))
                if len(seen) > CACHE_WORDS:
                    seen = Counter(dict(seen.most_common(CACHE_WORDS // 4)))
        top = seen.most_common(TASK_WORDS)
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())}
        )

    counted = docs.select(F.col(text).cast("string")).mapInArrow(run, "word string, n long")
    totals = counted.groupBy("word").agg(F.sum("n").alias("n"))
    return [r[0] for r in totals.orderBy(F.desc("n"), "word").limit(size).collect()]


class _Lengths(dict):
    """Token counts of pre-tokens: the frequent ones, and misses as they come."""

    def __init__(self, tokenizer, frequent: dict[str, int]):
        super().__init__(frequent)
        self.tokenizer, self.frequent = tokenizer, frequent

    def learn(self, words: set[str]) -> None:
        if len(self) > len(self.frequent) + CACHE_WORDS:
            self.clear()
            self.update(self.frequent)
        missing = [w for w in words if w not in self]
        found = self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)
        self.update(zip(missing, (len(x.ids) for x in found), strict=True))


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    table_size: int = 65_536,
    limit: int = 1024,
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` for every row.

    ``vocabulary`` is a byte-level tokenizer file; ``pattern`` splits a text
    into its pre-tokens. Special strings inside a text count as one token, as
    the file's library takes them. The broadcast is ``table_size`` frequent
    pre-tokens with their lengths, a bounded table; other pre-tokens are
    encoded once per worker while its cache holds them. A null text counts as
    empty, with 0 bytes and 0 tokens; repeated rows each come out; other
    columns are not used; no rows give no rows.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as file:
        model = file.read()
    tokenizer = Tokenizer.from_str(model)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    words = frequent_words(docs, text, pattern, table_size)
    lengths = {w: len(e.ids) for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), strict=True)}
    shared = spark.sparkContext.broadcast((model, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own, frequent = shared.value
        known = _Lengths(Tokenizer.from_str(own), frequent)
        split = regex.compile(pattern).findall
        cut = regex.compile("|".join(map(regex.escape, special))) if special else None
        for batch in batches:
            sizes, counts = [], []
            for texts in _pieces(batch.column(1)):
                parts = []  # of each text, its pre-tokens and its special strings
                for value in texts:
                    between = cut.split(value) if cut else [value]
                    parts.append(([w for b in between for w in split(b)], len(between) - 1))
                known.learn({w for found, _ in parts for w in found})
                counts += [sum(map(known.__getitem__, found)) + extra for found, extra in parts]
                sizes += [len(value.encode()) for value in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
