"""SimHash near-duplicates through an inverted index on byte positions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_insight.llm.common import spread_join
from retail_insight.sources.workspace import stage

BYTES = 8
SEED = 42
PART = 1024  # fingerprints of one posting that are compared in one piece


def fingerprint_of(text: str | bytes | None, words: int = 4) -> int:
    """The signed 64-bit SimHash of one text; zero if it has no words."""
    data = text.encode() if isinstance(text, str) else text or b""
    tokens = data.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not tokens:
        return 0
    width = min(words, len(tokens))
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):  # a long text is counted piece by piece
        piece = hashes[at : at + 65_536].view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, row: str | None = None
) -> DataFrame:
    """``id``, ``fp``, a long, and ``row`` (a long, if it is named) for every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found = [fingerprint_of(t.as_py(), words) for t in texts]
            columns = [batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "row"][: len(columns)])

    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(
        F.col(doc_id).alias("id"),
        F.col(text).cast("string").alias("text"),
        *([F.col(row).cast("long").alias("row")] if row else []),
    )
    return slim.mapInArrow(run, f"id {kind}, fp long" + ", row long" * bool(row))


def posting_positions(distance: int = 4) -> list[tuple[int, ...]]:
    """Byte positions such that any fingerprints within ``distance`` bits agree on all of one entry.

    They share at least 8 - ``distance`` whole bytes. For four shared bytes,
    twenty triples suffice: with the positions in three classes, those inside
    one class and those with two in a class and one in the next. For other
    distances every choice of the guaranteed bytes is listed.
    """
    shared = BYTES - distance
    if shared != 4:
        return list(combinations(range(BYTES), shared))
    shape = {(3, 0, 0), (0, 3, 0), (0, 0, 3), (2, 1, 0), (0, 2, 1), (1, 0, 2)}
    return [
        triple
        for triple in combinations(range(BYTES), 3)
        if tuple(sum(p % 3 == c for p in triple) for c in range(3)) in shape
    ]


def _posting_key(number: int, positions: tuple[int, ...]) -> Column:
    """A hash-free key: which entry, then the bytes at its positions."""
    key = F.lit(number).cast("long")
    for p in positions:
        byte = F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("long"))
        key = F.shiftleft(key, 8).bitwiseOR(byte)
    return key


def _forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that span what is linked in one posting: a root with each member.

    For a print in turn, the shared positional bytes with all not yet reached
    are tallied; those with the guaranteed count are verified bit by bit.
    """
    left, links = np.unique(prints), []
    while len(left) > 1:
        root, queue, left = int(left[0]), [left[0]], left[1:]
        while queue and len(left):
            differing = left ^ queue.pop()
            tally = (differing.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            near = np.flatnonzero(tally >= BYTES - distance)
            near = near[np.bitwise_count(differing[near]) <= distance]
            if len(near):
                found = left[near]
                links += [(root, int(x)) for x in found.view(np.int64)]
                queue.extend(found)
                left = np.delete(left, near)
    return [(int(np.uint64(r).view(np.int64)), m) for r, m in links]


def links_between(prints: DataFrame, distance: int = 4, part: int = PART) -> DataFrame:
    """Links ``u``, ``v`` with the same connected groups as all pairs within ``distance``.

    ``prints`` has distinct ``fp``. Each print goes to every posting of the
    index; a posting with more than ``part`` prints is cut into parts, and
    every two parts are compared as a task of their own, so no pair is lost
    and no task holds more than about twice ``part``. From each comparison
    only a spanning forest leaves, never all pairs.
    """
    keys = [_posting_key(i, p) for i, p in enumerate(posting_positions(distance))]
    postings = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parted = postings.join(sizes, "key").withColumns(
        {
            "parts": F.ceil(F.col("n") / part).cast("int"),
            "own": F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / part)).cast("int"),
        }
    )
    dealt = parted.select(
        "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    ).select("key", "fp", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    pieces = dealt.groupBy("key", "a", "b").agg(F.collect_list("fp").alias("fps")).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            links = set()
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                links.update(_forest(flat[a:b], distance))
            u, v = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return pieces.mapInArrow(run, "u long, v long").distinct()


def connected(links: DataFrame) -> DataFrame:
    """``member`` and ``root``, the least of its group, for every linked value.

    Alternates two steps until nothing changes: each value hands its larger
    neighbours, then its smaller ones, to the least value it knows. Every step
    aggregates in the map tasks, deals hot values by a salt, and is staged.
    """
    edges, before = links.select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")), None
    while True:
        both = edges.select(F.col("lo").alias("x"), F.col("hi").alias("y")).union(edges.select("hi", "lo"))
        least = both.groupBy("x").agg(F.min("y").alias("m"))
        large = (
            spread_join(both, least, ["x"], by="y")
            .where("y > x")
            .select(F.least("x", "m").alias("lo"), F.col("y").alias("hi"))
            .distinct()
        )
        large = stage(large, "links")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = spread_join(large, least, ["hi"], by="lo").where("lo > m")
        small = least.select(F.col("m").alias("lo"), "hi").union(
            moved.select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        )
        edges = stage(small.distinct(), "links")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first()
        if state == before:
            return edges.select(F.col("hi").alias("member"), F.col("lo").alias("root"))
        before = state


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 4,
    distance: int = 4,
    row: str | None = None,
) -> DataFrame:
    """One row per document: its id, ``fp`` and ``component_id``.

    The component is the smallest id that can be reached over links of
    ``distance`` or fewer differing bits. Texts without words, null or empty,
    have fingerprint zero and link like any other. A null id is passed over
    for the component unless a group has no other; rows that repeat an id each
    come out. An empty table gives no rows; other columns are not used.

    ``row`` names a column of distinct longs. It then comes out too, with
    ``first``: true for one row of each group, that of the smallest id, null
    last, and of these the smallest ``row``.
    """
    marked = stage(fingerprints(docs, doc_id, text, words, row), "fingerprints")
    least_id = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")) if row else F.min("id")
    first = stage(marked.groupBy("fp").agg(least_id.alias("first_id")), "distinct-fingerprints")
    links = stage(links_between(first.select("fp"), distance), "links")
    groups = connected(links)
    rooted = first.join(groups, F.col("fp") == F.col("member"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    chosen = spread_join(rooted, least, ["root"], by="fp").select("fp", "component_id")
    found = spread_join(marked, chosen, ["fp"], by="row" if row else "id")
    if row is None:
        return found.select(F.col("id").alias(doc_id), "fp", "component_id")
    return found.select(
        F.col("id").alias(doc_id),
        "fp",
        F.col("component_id.id").alias("component_id"),
        F.col("row").alias(row),
        (F.col("row") == F.col("component_id.row")).alias("first"),
    )


def hex_fingerprint(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
