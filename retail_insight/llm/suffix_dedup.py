"""Repeated long byte strings across documents, by a distributed difference cover.

Only the order of suffixes up to ``length`` bytes matters here, so names stand
for the sorted strings: suffixes that start with equal bytes get equal names.
Positions whose residue lies in a difference cover are named first; any two
equal strings of ``length`` bytes hold a sampled position at the same place.
Suffixes between samples are named in a second round, and only where their
string of ``length`` bytes holds a sample that a second document has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_insight.llm.common import spread_join
from retail_insight.sources.workspace import stage, stage_by

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
NAMES_PER_RANGE = 1_000_000
LAST = np.iinfo(np.int64).max  # stands for a null id: after all others
# Perfect difference sets, every residue once as a difference.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def cover_for(length: int) -> int:
    """The widest modulus that leaves sampled strings of 24 bytes or more, if any does."""
    if length < 8:
        raise ValueError("strings of fewer than 8 bytes can't be named")
    return max(v for v in COVERS if v == 1 or length - v + 1 >= 24)


def _squeezed(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(planes.tobytes(), 3)


def _released(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


class _Chunk:
    """The documents of one chunk as one run of bytes."""

    def __init__(self, row: dict, length: int):
        self.key, self.length = row["chunk"], length
        self.data = zstandard.decompress(row["data"])
        self.ids = np.array([LAST if i is None else i for i in row["ids"]], np.int64)
        self.raw_ids = row["ids"]
        sizes = np.array(row["sizes"], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.copies = np.zeros(len(sizes), bool)
        self.copies[row.get("copies") or []] = True
        padded = np.frombuffer(self.data + bytes(16), np.uint8)
        self.words = np.zeros(len(self.data) + 8, np.uint64)  # the eight bytes from each place on
        for r in range(8):
            part = padded[r:]
            part = part[: len(part) // 8 * 8].view("<u8")
            target = self.words[r::8]
            target[: min(len(part), len(target))] = part[: len(target)]

    def names(self, at: np.ndarray, size: int, mix: np.uint64) -> np.ndarray:
        """A 64-bit name for the ``size`` bytes from each of these places."""
        name = np.full(len(at), mix ^ np.uint64(size), np.uint64)
        for offset in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
            name ^= self.words[at + offset]
            name *= mix
            name ^= name >> np.uint64(32)
        return name * mix ^ name >> np.uint64(29)

    def _inside(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The places whose string ends within a document to be looked at, and their documents."""
        doc = np.searchsorted(self.ends, at, side="right")
        fits = (at + size <= self.ends[doc]) & ~self.copies[doc]
        return at[fits], doc[fits]

    def sampled(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the difference cover, their documents and their names."""
        modulus = cover_for(self.length)
        base = np.arange(0, len(self.data), modulus, dtype=np.int64)
        at = (base[:, None] + np.array(COVERS[modulus])).reshape(-1)
        at, doc = self._inside(at[at < len(self.data)], self.length - modulus + 1)
        return at, doc, self.names(at, self.length - modulus + 1, MIX[0]) >> np.uint64(64 - bits)

    def suffixes(self, bits: int, repeated: Callable) -> tuple[np.ndarray, ...]:
        """Places with a sample that repeats: their documents' ids, names and check names."""
        at, doc, name = self.sampled(bits)
        distinct, inverse = np.unique(name, return_inverse=True)
        found = repeated(distinct)
        first, last = np.full(len(distinct), LAST), np.full(len(distinct), -LAST)
        np.minimum.at(first, inverse, doc)
        np.maximum.at(last, inverse, doc)
        shared = (found | (first != last))[inverse]
        seen = np.zeros(len(self.data) + self.length + 1, np.int32)
        seen[at[shared] + 1] = 1  # running count of samples that occur in two documents
        seen = np.cumsum(seen, dtype=np.int32)
        places = np.arange(len(self.data), dtype=np.int64)
        open_places = places[seen[places + cover_for(self.length)] > seen[places]]
        open_places, doc = self._inside(open_places, self.length)
        check = (self.names(open_places, self.length, MIX[1]) >> np.uint64(32)).astype(np.uint32)
        return open_places, self.ids[doc], self.names(open_places, self.length, MIX[0]), check


def _chunks(docs: DataFrame) -> DataFrame:
    """Documents in chunks of about CHUNK_BYTES: ids, sizes, digests, and the bytes, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0

        def chunk() -> pa.RecordBatch:
            row = {
                "chunk": pa.array([(task << 32) + done], pa.int64()),
                "ids": pa.array([ids], pa.list_(pa.int64())),
                "sizes": pa.array([list(map(len, texts))], pa.list_(pa.int64())),
                "digests": pa.array([[hashlib.sha256(t).digest() for t in texts]], pa.list_(pa.binary())),
                "data": pa.array([zstandard.compress(b"".join(texts), 6)], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True):
                ids.append(key.as_py())
                texts.append(value.as_py() or b"")
                held += len(texts[-1]) + 64
                if held >= CHUNK_BYTES:
                    yield chunk()
                    ids, texts, held, done = [], [], 0, done + 1
        if ids:
            yield chunk()

    return docs.mapInArrow(
        run, "chunk long, ids array<long>, sizes array<long>, digests array<binary>, data binary"
    )


def _later_copies(chunks: DataFrame) -> DataFrame:
    """``chunk`` and the places in it of documents whose whole text a smaller id has."""
    every = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "digests")).alias("place", "doc")).select(
        "chunk", "place", F.coalesce("doc.ids", F.lit(int(LAST))).alias("id"), F.col("doc.digests").alias("digest")
    )
    first = every.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    late = spread_join(every, first.drop("n"), ["digest"], by="place").where("id > first")
    return late.groupBy("chunk").agg(F.collect_list("place").alias("copies"))


def _ranges(sorted_names: np.ndarray, bits: int, ranges: int) -> Iterator[tuple[int, slice]]:
    """The names by equal ranges of their leading 32 bits: range number and where its names are.

    Only ranges that hold names are visited, so the work is that of the names,
    however many ranges the whole input has.
    """
    which = (sorted_names >> np.uint64(bits - 32)) * np.uint64(ranges) >> np.uint64(32)
    bounds = [*np.flatnonzero(np.diff(which, prepend=np.uint64(ranges))).tolist(), len(which)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        yield int(which[a]), slice(a, b)


def _flags(found: list | None, sorted_names: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """The answers to the sorted names, put together from their ranges."""
    out = np.zeros(len(sorted_names), bool)
    answers = {x["range"]: x["flags"] for x in found or ()}
    for r, part in _ranges(sorted_names, bits, ranges):
        n = part.stop - part.start
        out[part] = np.unpackbits(np.frombuffer(answers[r], np.uint8), count=n).astype(bool)
    return out


def _answered(names: DataFrame, answer: Callable) -> DataFrame:
    """Each range's names compared in one group; answers are gathered by chunk."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        flags = answer(rows)
        return pa.table(
            {
                "chunk": pa.array([r["chunk"] for r in rows], pa.int64()),
                "range": pa.array([r["range"] for r in rows], pa.int32()),
                "flags": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary()),
            }
        )

    compared = names.groupBy("range").applyInArrow(run, "chunk long, range int, flags binary")
    return compared.groupBy("chunk").agg(F.collect_list(F.struct("range", "flags")).alias("found"))


def _in_two_chunks(rows: list[dict]) -> list[np.ndarray]:
    """Sort the sampled names of all chunks; equal neighbours repeat."""
    parts = [np.cumsum(_released(r["names"], "<u8")) for r in rows]
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    flags = np.zeros(len(every), bool)
    flags[order[1:]] |= same
    flags[order[:-1]] |= same
    return np.split(flags, np.cumsum([len(p) for p in parts])[:-1])


def _has_smaller(rows: list[dict]) -> list[np.ndarray]:
    """Sort the suffix names of all chunks; of equal neighbours, the smallest id comes first."""
    parts = [np.cumsum(_released(r["names"], "<u8")) for r in rows]
    name = np.concatenate(parts)
    check = np.concatenate([_released(r["checks"], f"<u{r['check_size']}") for r in rows])
    own = np.concatenate(
        [_released(r["ids"], f"<u{r['id_size']}").astype(np.int64) + r["least"] for r in rows]
    )
    order = np.lexsort((own, check, name))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (name[order][1:] != name[order][:-1]) | (check[order][1:] != check[order][:-1])
    least = own[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    flags = np.zeros(len(order), bool)
    flags[order] = least < own[order]
    return np.split(flags, np.cumsum([len(p) for p in parts])[:-1])


def _grouped(ids: np.ndarray, name: np.ndarray, check: np.ndarray):
    """Order of the suffixes by name, where each name starts in it, and the group of each."""
    order = np.lexsort((ids, check, name))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (name[order][1:] != name[order][:-1]) | (check[order][1:] != check[order][:-1])
    return order, np.flatnonzero(fresh), np.cumsum(fresh) - 1


def repeated_bytes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50
) -> DataFrame:
    """Every document's bytes that repeat ``length`` bytes of one with a smaller id.

    Returns ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans``
    (start and end of the maximal removed runs) and ``kept``, the remaining
    bytes. Strings are judged on the input, whole texts as UTF-8, and never
    cross documents; overlaps count. A null text counts as empty; ids are
    integers, and a null id comes after all others; rows with equal ids are
    not smaller than each other. Other columns are not used; no rows give none.

    Texts are staged once, in chunks bucketed by chunk. Round one sends the
    distinct names of a chunk's sampled strings to ranges of names, and gets
    one bit a name back; round two does the same for the suffixes that remain.
    A string that occurs everywhere costs one name a chunk. Documents that
    copy a whole text are settled by their digest and take no part.
    Suffix names have 72 to 96 bits by the size of the input; sampled names
    have eight bits more than the number of samples needs.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    modulus = cover_for(length)
    samples = total * len(COVERS[modulus]) // modulus + 1
    bits = min(64, max(32, samples.bit_length() + 8))
    ranges = samples // NAMES_PER_RANGE + 1
    # 64 bits and these bytes more: eight bits beyond what the pairs of all places need, 96 bits at most.
    check_size = next((s for s in (1, 2) if 64 + 8 * s >= 2 * total.bit_length() + 8), 4)
    chunks = stage_by(_chunks(slim), "chunk", total // BUCKET_BYTES + 1, "texts")
    copies = stage(_later_copies(chunks), "copies")
    texts = chunks.drop("digests").join(copies, "chunk", "left")

    def sample_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row, length)
                names = np.unique(chunk.sampled(bits)[2])
                for r, part in _ranges(names, bits, ranges):
                    deltas = np.diff(names[part], prepend=np.uint64(0))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "range": pa.array([r], pa.int32()),
                            "chunk": pa.array([chunk.key], pa.int64()),
                            "names": pa.array([_squeezed(deltas)], pa.binary()),
                        }
                    )

    sampled = texts.mapInArrow(sample_names, "range int, chunk long, names binary")
    first = stage(_answered(sampled, _in_two_chunks), "sample-answers").withColumnRenamed("found", "samples")
    texts = texts.join(first, "chunk", "left")

    def suffixes(row: dict) -> tuple:
        chunk = _Chunk(row, length)
        at, ids, name, check = chunk.suffixes(bits, lambda names: _flags(row["samples"], names, bits, ranges))
        return chunk, at, ids, name, check.astype(f"<u{check_size}")

    def suffix_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk, _, ids, name, check = suffixes(row)
                order, starts, _ = _grouped(ids, name, check)
                firsts = order[starts]
                least = int(ids.min()) if len(ids) else 0
                above = (ids[firsts] - least).astype(np.uint64)
                size = next(s for s in (2, 4, 8) if s == 8 or not len(above) or int(above.max()) >> 8 * s == 0)
                for r, part in _ranges(name[firsts], 64, ranges):
                    rows = firsts[part]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "range": pa.array([r], pa.int32()),
                            "chunk": pa.array([chunk.key], pa.int64()),
                            "names": pa.array([_squeezed(np.diff(name[rows], prepend=np.uint64(0)))], pa.binary()),
                            "checks": pa.array([_squeezed(check[rows])], pa.binary()),
                            "check_size": pa.array([check_size], pa.int32()),
                            "ids": pa.array([_squeezed(above[part].astype(f"<u{size}"))], pa.binary()),
                            "id_size": pa.array([size], pa.int32()),
                            "least": pa.array([least], pa.int64()),
                        }
                    )

    named = texts.mapInArrow(
        suffix_names,
        "range int, chunk long, names binary, checks binary, check_size int, ids binary, id_size int, least long",
    )
    second = stage(_answered(named, _has_smaller), "suffix-answers").withColumnRenamed("found", "suffixes")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk, at, ids, name, check = suffixes(row)
                order, starts, group = _grouped(ids, name, check)
                answers = _flags(row["suffixes"], name[order[starts]], 64, ranges)
                smaller = answers[group] | (ids[order] > ids[order[starts]][group])
                repeats = at[order[smaller]]
                edge = np.zeros(len(chunk.data) + 1, np.int32)
                np.add.at(edge, repeats, 1)
                np.add.at(edge, repeats + length, -1)
                gone = np.cumsum(edge)[:-1] > 0
                for doc in np.flatnonzero(chunk.copies & (chunk.ends - chunk.starts >= length)):
                    gone[chunk.starts[doc] : chunk.ends[doc]] = True
                yield from _cut_out(chunk, gone)

    return texts.join(second, "chunk", "left").mapInArrow(
        cut,
        "doc_id long, n_bytes long, n_removed long, n_spans long, "
        "spans array<struct<start: long, end: long>>, kept binary",
    )


def _cut_out(chunk: _Chunk, gone: np.ndarray, piece: int = 500) -> Iterator[pa.RecordBatch]:
    """The documents of a chunk without the bytes marked as gone, some hundred at a time."""
    data = np.frombuffer(chunk.data, np.uint8)
    for first in range(0, len(chunk.ids), piece):
        sizes, removed, spans, kept = [], [], [], []
        for a, b in zip(chunk.starts[first : first + piece], chunk.ends[first : first + piece], strict=True):
            mask = gone[a:b]
            turns = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
            spans.append([{"start": int(s), "end": int(e)} for s, e in turns.reshape(-1, 2)])
            sizes.append(int(b - a))
            removed.append(int(mask.sum()))
            kept.append(data[a:b][~mask].tobytes())
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(chunk.raw_ids[first : first + piece], pa.int64()),
                "n_bytes": pa.array(sizes, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array([len(s) for s in spans], pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.array(kept, pa.binary()),
            }
        )
