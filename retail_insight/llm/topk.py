"""Exact top-k inner products over a bit-sliced index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retail_insight.sources.workspace import stage

BLOCK_ROWS = 131_072  # candidates of one piece of the index
BATCH_QUERIES = 256  # queries that meet a range of the index together
RANGE_BLOCKS = 8  # blocks that a batch of queries meets in one task
LEAST_QUERIES = 32  # of a batch, where smaller ones would only give each core more tasks
TASKS_PER_CORE = 4  # wanted at least, so that cores end together
COMPONENTS = 1 << 23  # of one block: wider vectors make blocks of fewer rows
READ_COMPONENTS = 1 << 20  # that are floored together
EXACT_COMPONENTS = 1 << 18  # that are scored together beside the index, as Python integers
EXACT_ROWS = 4_096
EXACT_TASKS = 8  # for the rows of one block, as these take longer
LARGEST = 1 << 24  # of an indexed component's size, with up to 1,024 components; see _largest
SCORE_BITS = 58  # of an indexed score; leaves room for the index's own sums in 64 bits
PLACE = ("side", "score", "beyond")  # a score of any size, see _placed
FLOORED = "vec_id long, q binary, v array<double>"
PLACED = pa.schema(
    [("query_id", pa.int64()), ("vec_id", pa.int64()), ("side", pa.int32()), ("score", pa.int64()), ("beyond", pa.binary())]
)


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id`` and ``v``, the components, of the vectors that take part."""
    cells = F.col("v")
    finite = F.forall(cells, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")
    ).where(F.col("vec_id").isNotNull() & cells.isNotNull() & finite)


def one_per_id(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id`` and ``v``; of rows that repeat an id, the usable one with the greatest vector."""
    ids = vectors.select(F.col(vec_id).cast("long").alias("vec_id")).where("vec_id IS NOT NULL")
    most = ids.groupBy("vec_id").count().agg(F.max("count")).first()[0]
    if (most or 0) > 1:
        return usable(vectors, vec_id, vector).groupBy("vec_id").agg(F.max("v").alias("v"))
    kind = vectors.schema[vector].dataType.simpleString()
    cells = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), cells.alias("v"))


def _largest(sizes: np.ndarray) -> np.ndarray:
    """What floored components stay below so that products of so many add up within ``SCORE_BITS``: 2^29 for one, 2^24 for 1,024."""
    found, at = np.unique(sizes, return_inverse=True)
    bits = [(SCORE_BITS - (max(n, 1) - 1).bit_length()) // 2 for n in found.tolist()]
    return np.array([2.0**b for b in bits])[at]


def _cut(batches: Iterator[pa.RecordBatch], sizes, rows: int, components: int) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of at most so many rows, and components when filled up to one width, but one row at least."""
    held: list[pa.RecordBatch] = []
    count = widest = 0
    for batch in batches:
        wide, start = sizes(batch), 0
        while start < batch.num_rows:
            width = np.maximum.accumulate(np.maximum(wide[start:], widest))
            cells = np.arange(count + 1, count + 1 + len(width)) * width
            take = min(int(np.searchsorted(cells, components, "right")), rows - count)
            if not take and held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, count, widest = [], 0, 0
                continue
            held.append(batch.slice(start, max(take, 1)))
            start, count, widest = start + held[-1].num_rows, count + held[-1].num_rows, int(width[held[-1].num_rows - 1])
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _list_sizes(batch: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(batch["v"]), 0).to_numpy().astype(np.int64)


def _sizes(batch: pa.RecordBatch) -> np.ndarray:
    """Components of each row, floored or not."""
    return pc.fill_null(pc.binary_length(batch["q"]), 0).to_numpy().astype(np.int64) // 4 + _list_sizes(batch)


def floored(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id`` with ``q``, the floored components as 32-bit integers; for vectors beyond the index ``v`` instead.

    Rows with a null id, a null vector, or a component that is null or not finite are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches, _list_sizes, BLOCK_ROWS, READ_COMPONENTS):
            batch = batch.filter(pc.and_(batch["vec_id"].is_valid(), batch["v"].is_valid()))
            ids, sizes = batch["vec_id"].to_numpy(), _list_sizes(batch)
            cells = batch["v"].flatten().cast(pa.float64())
            x, row = pc.fill_null(cells, math.nan).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(ids)), sizes)
            kept, fits = np.ones(len(ids), bool), np.ones(len(ids), bool)
            kept[row[~np.isfinite(x)]] = False
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = x * float(scale)
                fits[row[~(np.abs(scaled) < _largest(sizes)[row])]] = False
            fits &= kept
            data = np.floor(scaled[fits[row]]).astype("<i4")
            ends = np.concatenate([[0], 4 * np.cumsum(sizes[fits])]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), int(fits.sum()), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            for q, v, some in (
                (packed, pa.nulls(len(packed), pa.list_(pa.float64())), fits),
                (None, batch["v"].filter(pa.array(kept & ~fits)).cast(pa.list_(pa.float64())), kept & ~fits),
            ):
                q = pa.nulls(len(v), pa.binary()) if q is None else q
                if len(v):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), q, v], names=["vec_id", "q", "v"])

    return vectors.mapInArrow(run, FLOORED)


def _integers(rows: pa.RecordBatch, width: int, scale: int) -> np.ndarray:
    """The floored components of any size, as Python integers, filled up with zeros."""
    out = np.zeros((rows.num_rows, width), object)
    for i, (q, v) in enumerate(zip(rows["q"].to_pylist(), rows["v"].to_pylist(), strict=True)):
        if q is not None:
            values = np.frombuffer(q, "<i4").tolist()
        else:
            values = [math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale for x in v]
        out[i, : len(values)] = np.array(values, object)
    return out


def _placed(score: int) -> tuple[int, int | None, bytes | None]:
    """Columns in whose order scores of any size sort: the side of the 64-bit range, the score, bytes."""
    if -(1 << 63) <= score < 1 << 63:
        return 0, score, None
    size = (abs(score).bit_length() + 7) // 8
    key = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return (1, None, key) if score > 0 else (-1, None, bytes(255 - b for b in key))


def _matrix(rows: pa.RecordBatch) -> np.ndarray:
    """The floored components as rows of one width, filled up with zeros."""
    sizes = _sizes(rows)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(rows["q"].to_pylist()), "<i4")
    return out


def _bytes(rows: pa.RecordBatch) -> bytes:
    with pa.BufferOutputStream() as out:
        with pa.ipc.new_stream(out, rows.schema) as writer:
            writer.write_batch(rows)
        return out.getvalue().to_pybytes()


def _rows(data: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(data.as_buffer()).read_next_batch()


class Slices:
    """Bit slices of the attributes of a block of rows: each plane is the bitmap of one bit of one column.

    Components are taken above their column's least value, so that all slices
    are of numbers without a sign. ``planes`` has them by column, lowest bit
    first, and then the complements of all.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        least, bits, planes = values.min(axis=0).astype(np.int64), [], []
        for j in range(values.shape[1]):
            above = values[:, j].astype(np.int64) - least[j]
            bits.append(int(above.max()).bit_length())
            planes += [self._bitmap(above >> b & 1) for b in range(bits[-1])]
        none = self._bitmap(np.zeros(len(ids), np.int64))
        self._hold(ids, least, np.array(bits, np.int64), np.array(planes, np.uint64).reshape(-1, len(none)))

    def _hold(self, ids: np.ndarray, least: np.ndarray, bits: np.ndarray, planes: np.ndarray) -> None:
        self.ids, self.least, self.bits, self.count = ids, least, bits, len(planes)
        self.planes = np.concatenate([planes, ~planes])
        self.first = np.cumsum(bits) - bits
        self.every = self._bitmap(np.ones(len(ids), np.int64))
        self.none = np.zeros_like(self.every)
        self.room: dict[str, np.ndarray] = {}

    def packed(self) -> bytes:
        """The block as bytes, for ``unpacked``."""
        head = np.array([len(self.ids), len(self.least)], np.int64)
        numbers = np.concatenate([head, self.ids, self.least, self.bits]).astype("<i8")
        return numbers.tobytes() + self.planes[: self.count].astype("<u8").tobytes()

    @classmethod
    def unpacked(cls, data: pa.Buffer) -> Slices:
        numbers = np.frombuffer(data, np.uint8).copy().view("<i8")
        rows, width = numbers[:2].tolist()
        ids, least, bits, planes = np.split(numbers[2:], [rows, rows + width, rows + 2 * width])
        found = cls.__new__(cls)
        found._hold(ids, least, bits, planes.view("<u8").reshape(-1, (rows + 63) // 64))
        return found

    def _kept(self, name: str, planes: int) -> np.ndarray:
        """Space for so many planes, the same for all queries."""
        if name not in self.room or len(self.room[name]) < planes:
            self.room[name] = np.empty((planes, len(self.none)), np.uint64)
        return self.room[name]

    @staticmethod
    def _bitmap(bits: np.ndarray) -> np.ndarray:
        words = np.zeros((len(bits) + 63) // 64 * 8, np.uint8)
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        words[: len(packed)] = packed
        return words.view(np.uint64)

    def _terms(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The planes that a query adds up, by binary place, and where each place begins.

        Columns of negative weight count by the complements, whose sum with
        the column is known (see ``scores_above``).
        """
        size, base = np.abs(query), self.first + np.where(query < 0, self.count, 0)
        shifts, most = np.arange(int(size.max(initial=0)).bit_length()), int(self.bits.max(initial=0))
        within = np.arange(most) < self.bits[:, None]
        column, shift, bit = np.nonzero((size[:, None] >> shifts & 1).astype(bool)[:, :, None] & within[:, None, :])
        place = shift + bit
        order = np.argsort(place, kind="stable")
        return (base[column] + bit)[order], np.searchsorted(place[order], np.arange(len(shifts) + most + 1))

    def scores_above(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """Slices of the inner products less an offset, and the offset; valid until the next call.

        All planes of one binary place are added three at a time into a sum
        and a carry for the next place, until each place has one plane. The
        planes lie side by side, so that one operation adds many triples.
        """
        offset = int((query * self.least).sum() + (np.minimum(query, 0) * ((1 << self.bits) - 1)).sum())
        terms, begins = self._terms(query)
        out, place, carried = self._kept("out", 64), 0, 0
        while place + 1 < len(begins) or carried:
            own = terms[begins[place] : begins[place + 1]] if place + 1 < len(begins) else terms[:0]
            open_, at = len(own) + carried, 0
            column = self._kept("column", open_)
            if carried:
                column[len(own) : open_] = self.room["carry"][:carried]
            if len(own):
                np.take(self.planes, own, axis=0, out=column[: len(own)], mode="clip")
            carry, both, carried = self._kept("carry", open_ // 2 + 1), self._kept("both", open_ // 3 + 1), 0
            while open_ >= 3:
                n = open_ // 3
                a, b, c = (column[at + i * n : at + (i + 1) * n] for i in range(3))
                over, t = carry[carried : carried + n], both[:n]
                np.bitwise_and(a, b, out=over)
                np.bitwise_xor(a, b, out=b)
                np.bitwise_and(b, c, out=t)
                np.bitwise_or(over, t, out=over)
                np.bitwise_xor(b, c, out=c)
                carried, at, open_ = carried + n, at + 2 * n, open_ - 2 * n
            if open_ == 2:
                np.bitwise_and(column[at], column[at + 1], out=carry[carried])
                np.bitwise_xor(column[at], column[at + 1], out=column[at + 1])
                carried, at = carried + 1, at + 1
            out[place] = column[at] if open_ else self.none
            place += 1
        return out[:place], offset

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best rows but ``own``; ties to smaller ids.

        Goes from the most significant slice down: rows whose bit is set come
        before those whose bit is not. Rows that are equal in every slice are
        the boundary, settled by id.
        """
        slices, offset = self.scores_above(query)
        open_rows, sure = self.every.copy(), self.none
        for row in np.flatnonzero(self.ids == own).tolist():
            open_rows[row >> 6] &= ~np.uint64(1 << (row & 63))
        k = min(k, int(np.bitwise_count(open_rows).sum()))
        for plane in slices[::-1]:
            ahead = open_rows & plane
            reached = int(np.bitwise_count(sure | ahead).sum())
            if reached > k:
                open_rows = ahead
            else:
                sure, open_rows = sure | ahead, open_rows & ~plane
                if reached == k:
                    break
        rows = self._rows(sure)
        if len(rows) < k:
            boundary = self._rows(open_rows)
            rows = np.concatenate([rows, boundary[np.argsort(self.ids[boundary], kind="stable")][: k - len(rows)]])
        scores = np.full(len(rows), offset, np.int64)
        for b, plane in enumerate(slices):
            scores += (plane[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << b
        return rows, scores

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: len(self.ids)]
        return np.flatnonzero(bits)


def top_k(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    every: int = 20,
    k: int = 20,
    scale: int = 64,
    block_rows: int = BLOCK_ROWS,
    batch_queries: int = BATCH_QUERIES,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's k best other rows.

    Queries are the rows whose id is divisible by ``every``; scores are inner
    products of components floored after ``scale``. All vectors are indexed:
    blocks of at most ``block_rows`` rows become bit slices once, and are dealt
    to ranges of blocks; queries are dealt to batches of about
    ``batch_queries``. A task's work is one batch on one range: it reads both
    where they were shuffled to, so neither is copied, and holds one block and
    the batch's best rows. Scores are made by bitmap addition, and the best are
    read off from the top slice down. Each range returns at most k rows a
    query; these are ranked once more.

    Vectors with components too large for 64-bit sums (``_largest``) are
    scored beside the index, in integers of any size, as queries against all
    rows and as candidates of all queries. A score beyond 64 bits has its rank,
    but is given as null.

    Ties go to the smaller id. Rows with a null id, a null vector, or a
    component that is null or not finite take no part. An id has one row in
    each ranking; of rows that repeat it, the one with the greatest vector counts.
    Shorter vectors count as padded with zeros. Empty vectors score 0. No rows
    give no rows; other columns are not used.
    """
    ready = stage(floored(one_per_id(vectors, vec_id, vector), scale), "floored")
    asks = F.col("vec_id") % every == 0
    size = F.coalesce(F.octet_length("q") / 4, F.size("v"))
    figures = ready.groupBy(F.col("q").isNull().alias("large")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(asks).alias("asked"), F.sum(size).alias("components")
    )
    found = {r["large"]: r for r in figures.collect()}
    cores = ready.sparkSession.sparkContext.defaultParallelism

    def parts(large: bool, more: int = 1) -> int:
        """Tasks that make a side's blocks, with about a full block each, or so many times more."""
        if large not in found:
            return 1
        rows, components = found[large]["rows"], int(found[large]["components"])
        return max(rows * more // block_rows, components * more // COMPONENTS) + 1

    def batches(large: bool, ranges: int) -> int:
        asked = found[large]["asked"] if large in found else 0
        return max(asked // batch_queries, min(TASKS_PER_CORE * cores // ranges, asked // LEAST_QUERIES)) + 1

    def dealt(rows: DataFrame, tasks: int, pieces, groups: int, name: str) -> DataFrame:
        """``name``: the pieces made of the rows, gathered by a hash of the id; whole tasks are dealt to the groups."""

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            for piece in pieces(rows):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([piece], pa.binary())], names=["part", name])

        gathered = rows.repartitionById(tasks, F.pmod(F.xxhash64("vec_id"), F.lit(tasks)).cast("int"))
        return gathered.mapInArrow(run, f"part int, {name} binary").repartitionById(groups, "part").select(name)

    def sliced(rows: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for piece in _cut(rows, _sizes, block_rows, COMPONENTS):
            yield Slices(piece["vec_id"].to_numpy(), _matrix(piece)).packed()

    def listed(rows: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        return map(_bytes, _cut(rows, _sizes, EXACT_ROWS, EXACT_COMPONENTS))

    def run(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pair in pairs:
            for block, batch in zip(pair["index"], pair["queries"], strict=True):
                index, asked = Slices.unpacked(block.as_buffer()), _rows(batch)
                values = np.zeros((asked.num_rows, len(index.least)), np.int64)
                given = _matrix(asked)[:, : len(index.least)]
                values[:, : given.shape[1]] = given
                for query, weights in zip(asked["vec_id"].to_pylist(), values, strict=True):
                    rows, scores = index.top(weights, query, k)
                    ids = index.ids[rows]
                    if query in best:
                        ids, scores = (np.concatenate(x) for x in zip(best[query], (ids, scores), strict=True))
                        order = np.lexsort((ids, -scores))[:k]
                        ids, scores = ids[order], scores[order]
                    best[query] = ids, scores
        for query, (ids, scores) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), query, np.int64)), pa.array(ids, pa.int64()), pa.array(scores)],
                names=["query_id", "vec_id", "score"],
            )

    def run_exactly(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {}
        for pair in pairs:
            for side in zip(pair["index"], pair["queries"], strict=True):
                rows, asked = map(_rows, side)
                width = max(int(_sizes(x).max(initial=0)) for x in (rows, asked))
                ids, components, values = rows["vec_id"].to_pylist(), _integers(rows, width, scale), _integers(asked, width, scale)
                for n, query in enumerate(asked["vec_id"].to_pylist()):
                    products = (components * values[n]).sum(axis=1).tolist() if width else [0] * len(ids)
                    scores = [(-s, i) for s, i in zip(products, ids, strict=True) if i != query]
                    best[query] = heapq.nsmallest(k, [*best.get(query, ()), *scores])
        for query, ranked in best.items():
            found_rows = [{"query_id": query, "vec_id": i, **dict(zip(PLACE, _placed(-s)))} for s, i in ranked]
            yield pa.RecordBatch.from_pylist(found_rows, schema=PLACED)

    def met(index: DataFrame, queries: DataFrame) -> DataFrame:
        return index.hint("shuffle_replicate_nl").crossJoin(queries)

    def asking(rows: DataFrame, groups: int) -> DataFrame:
        return dealt(rows.where(asks), groups, listed, groups, "queries")

    indexed, others = ready.where("q IS NOT NULL"), ready.where("q IS NULL")
    ranges = parts(False) // RANGE_BLOCKS + 1
    cells = met(dealt(indexed, parts(False), sliced, ranges, "index"), asking(indexed, batches(False, ranges)))
    merged = cells.mapInArrow(run, "query_id long, vec_id long, score long")
    if True in found:  # without any vectors beyond the index there is nothing to add
        merged = merged.select("query_id", "vec_id", F.lit(0).alias("side"), "score", F.lit(None).cast("binary").alias("beyond"))
        for rows, queries, large, tasks in (
            (ready, others, True, parts(False, EXACT_TASKS) + parts(True, EXACT_TASKS)),
            (others, indexed, False, parts(True, EXACT_TASKS)),
        ):
            cells = met(dealt(rows, tasks, listed, tasks, "index"), asking(queries, batches(large, tasks)))
            merged = merged.unionByName(
                cells.mapInArrow(run_exactly, "query_id long, vec_id long, side int, score long, beyond binary")
            )
    sides = [F.desc(c) for c in PLACE] if True in found else [F.desc("score")]
    order = Window.partitionBy("query_id").orderBy(*sides, "vec_id")
    return (
        merged.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
