"""Byte-level BPE: each distinct word of the corpus is encoded once, and joined back."""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_insight.sources.workspace import stage_by

CHUNK_BYTES = 4 << 20  # of text whose word positions are kept together
BUCKET_BYTES = 32 << 20
PIECE = 250  # documents that leave a chunk together
RANGE_BYTES = 8 << 20  # of text for one range of the word shuffle


def read_ranks(path: str) -> dict[bytes, int]:
    """The token-byte table of a rank file: a line for each token, base64 and number."""
    with open(path, "rb") as file:
        return {base64.b64decode(t): int(n) for t, n in map(bytes.split, file)}


def _packed(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(planes.tobytes(), 3)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` with these starts and lengths, one after the other."""
    ends = np.cumsum(lengths)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


def _word_ranges(words: list[str], ranges: int) -> list[dict]:
    """Numbered words by range of their hash: the numbers, and the words' bytes with their lengths."""
    coded = [w.encode() for w in words]
    place = np.fromiter((xxhash.xxh3_64_intdigest(w) % ranges for w in coded), np.int64, len(coded))
    order = np.argsort(place, kind="stable")
    out = []
    for numbers in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
        held = [coded[n] for n in numbers.tolist()]
        out.append(
            {
                "range": int(place[numbers[0]]),
                "numbers": _packed(np.diff(numbers, prepend=0).astype(np.int32)),
                "lengths": _packed(np.fromiter(map(len, held), np.int32, len(held))),
                "words": zstandard.compress(b"".join(held), 3),
            }
        )
    return out


def _explode_words(docs: DataFrame, pattern: str, ranges: int) -> DataFrame:
    """One row per chunk of documents: each position's word by number, and the distinct words by range."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    word_type = pa.list_(
        pa.struct([("range", pa.int32()), ("numbers", pa.binary()), ("lengths", pa.binary()), ("words", pa.binary())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, task, done = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0
        ids, counts, runs, size, words = [], [], [], 0, defaultdict()
        words.default_factory = words.__len__

        def chunk() -> pa.RecordBatch:
            row = {
                "chunk": pa.array([(task << 32) + done], pa.int64()),
                "ids": pa.array([ids], pa.list_(id_type)),
                "counts": pa.array([counts], pa.list_(pa.int32())),
                "positions": pa.array([_packed(np.concatenate(runs))], pa.binary()),
                "words": pa.array([_word_ranges(list(words), ranges) if words else []], word_type),
            }
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            id_type = batch.column(0).type
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                text = value.as_py() or ""
                found = split(text)
                ids.append(key.as_py())
                counts.append(len(found))
                runs.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                size += len(text) + 64
                if size >= CHUNK_BYTES:
                    yield chunk()
                    done += 1
                    ids, counts, runs, size, words = [], [], [], 0, defaultdict()
                    words.default_factory = words.__len__
        if ids:
            yield chunk()

    return docs.mapInArrow(
        run,
        f"chunk long, ids array<{kind}>, counts array<int>, positions binary, "
        "words array<struct<range: int, numbers: binary, lengths: binary, words: binary>>",
    )


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    decoded: bool = False,
) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` for every row: the token numbers of the whole text.

    ``ids`` is binary: the numbers as little-endian unsigned 32-bit integers.
    With ``decoded``, the ids are turned back by ``decode``'s table in the same
    pass over them, and their bytes follow as a column of that name.

    Texts are split by ``pattern``; each task numbers the distinct words of a
    chunk of its documents and keeps every position as such a number. The
    chunks' distinct words meet in one global shuffle, by ranges of the word's
    hash, where each distinct word is encoded once however many chunks hold
    it. The ids go back to the chunks, which are bucketed and stay in place,
    and positions turn into the documents' ids. What is shuffled is words per
    chunk, not words per text; a very common word has one entry a chunk.

    A null text counts as empty and gets no ids; repeated rows each
    come out; other columns are not used; no rows give no rows.
    """
    import tiktoken

    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary: bounded
    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = stage_by(
        _explode_words(slim, pattern, total // RANGE_BYTES + 1), "chunk", total // BUCKET_BYTES + 1, "words"
    )

    def encode_range(table: pa.Table) -> pa.Table:
        bpe = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=shared.value, special_tokens={})
        known: dict[bytes, list[int]] = {}
        sizes, tokens = [], []
        for lengths, words in zip(table["lengths"].to_pylist(), table["words"].to_pylist(), strict=True):
            flat, found, at = zstandard.decompress(words), [], 0
            for length in _unpacked(lengths, "<i4").tolist():
                word = flat[at : at + length]
                at += length
                if word not in known:
                    known[word] = bpe.encode_ordinary(word.decode())
                found.append(known[word])
            sizes.append(_packed(np.fromiter(map(len, found), np.int32, len(found))))
            tokens.append(_packed(np.fromiter(chain.from_iterable(found), np.uint32)))
        return pa.table(
            {
                "chunk": table["chunk"],
                "range": table["range"],
                "sizes": pa.array(sizes, pa.binary()),
                "tokens": pa.array(tokens, pa.binary()),
            }
        )

    coded = (
        chunks.select("chunk", F.explode("words").alias("w"))
        .select("chunk", "w.range", "w.lengths", "w.words")
        .groupBy("range")
        .applyInArrow(encode_range, "chunk long, range int, sizes binary, tokens binary")
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("range", "sizes", "tokens")).alias("coded"))
    )
    numbers = F.transform("words", lambda w: F.struct(w["range"].alias("range"), w["numbers"].alias("numbers")))
    placed = chunks.withColumn("words", numbers).join(coded, "chunk", "left")

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for row in batch.to_pylist():
                parts = {x["range"]: x for x in row["coded"] or ()}
                places = [np.cumsum(_unpacked(x["numbers"], "<i4")) for x in row["words"]]
                sizes = [_unpacked(parts[x["range"]]["sizes"], "<i4") for x in row["words"]]
                tokens = [_unpacked(parts[x["range"]]["tokens"], "<u4") for x in row["words"]]
                token = np.concatenate([np.zeros(0, "<u4"), *tokens])
                every = np.concatenate([np.zeros(0, np.int64), *sizes]).astype(np.int64)
                place = np.concatenate([np.zeros(0, np.int64), *places])
                size, start = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
                size[place], start[place] = every, np.cumsum(every) - every
                at = _unpacked(row["positions"], "<i4")
                ends = np.concatenate(([0], np.cumsum(np.array(row["counts"], np.int64))))
                for first in range(0, len(row["ids"]), PIECE):
                    own = ends[first : first + PIECE + 1]
                    words = at[own[0] : own[-1]]
                    token_ends = np.concatenate(([0], np.cumsum(size[words])))[own - own[0]]
                    flat = _gather(token, start[words], size[words]).tobytes()
                    spans = zip(token_ends.tolist(), token_ends[1:].tolist(), strict=False)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(row["ids"][first : first + PIECE], id_type),
                            pa.array(np.diff(token_ends), pa.int64()),
                            pa.array([flat[4 * a : 4 * b] for a, b in spans], pa.binary()),
                        ],
                        names=["doc_id", "n_tokens", "ids"],
                    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = reassemble(batches)
        return _decoded(found, 2, shared.value) if decoded else found

    return placed.select("chunk", "ids", "counts", "positions", "words", "coded").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids binary" + ", decoded binary" * decoded
    )


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the bytes that the numbers in ``ids`` stand for.

    The token-byte table is the vocabulary: bounded, so it is joined in the
    map tasks from a broadcast. Null or empty ids give no bytes; a number
    outside the table fails the job. A column named ``decoded`` is replaced.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)
    fields = [f for f in tokens.schema.fields if f.name.lower() != "decoded"]
    kept = tokens.select(*[F.col(f"`{f.name}`") for f in fields])
    place = [f.name.lower() for f in fields].index(ids.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(batches, place, shared.value)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return kept.mapInArrow(run, f"{schema}, decoded binary")


def _decoded(
    batches: Iterator[pa.RecordBatch], place: int, ranks: dict[bytes, int]
) -> Iterator[pa.RecordBatch]:
    """The batches, some hundred rows at a time, with the bytes for the ids in column ``place``."""
    table, start, size = _token_table(ranks)
    for whole in batches:
        for first in range(0, whole.num_rows, PIECE):
            batch = whole.slice(first, PIECE)
            numbers = (np.frombuffer(row.as_py() or b"", "<u4") for row in batch.column(place))
            found = [_gather(table, start[n], size[n]).tobytes() for n in numbers]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "decoded"]
            )


def _token_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens in the order of their numbers, and where each starts and how long it is.

    Numbers that no token has start beyond the table.
    """
    tokens = sorted((number, token) for token, number in ranks.items())
    table = np.frombuffer(b"".join(t for _, t in tokens), np.uint8)
    numbers = np.array([n for n, _ in tokens], np.int64)
    size = np.ones(int(numbers.max(initial=-1)) + 1, np.int64)
    start = np.full(len(size), len(table), np.int64)
    lengths = np.array([len(t) for _, t in tokens], np.int64)
    size[numbers], start[numbers] = lengths, np.cumsum(lengths) - lengths
    return table, start, size


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the hashes of the ids and of the decoded bytes."""
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
