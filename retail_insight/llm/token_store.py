"""Token numbers as raw files, and a minimal perfect hash index from document keys to places in them.

A store is a folder with, for each shard, a raw file of token numbers
(``ids/kind=ids/shard=K``), the list of its documents (``ids/kind=docs/shard=K``),
and the index as Parquet (``index``). Documents stand in ascending key order,
through the shards and inside them, each ended by the end number.
"""

from __future__ import annotations

import json
import re
import struct
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_insight.sources.workspace import new_path, stage

SHARD_BYTES = 32 << 20  # of text for one shard
ROW_BYTES = 64  # that a document counts for besides its text, so that a shard's documents are bounded too
BLOCK_KEYS = 1_024  # keys of one index block, on average
BUCKET_KEYS = 4  # keys that share a displacement, on average
MOST_TRIES = 1 << 22
CACHE_WORDS = 700_000
TOGETHER = 2_000  # words encoded in one go
CACHED_CHARS = 64  # longer words are not remembered
BATCH_BYTES = 4 << 20
BATCH_CHARS = 4 << 20  # of texts encoded in one go: the more, the fewer distinct words are looked up
RECORD = "<qi"  # tokens with the end number, bytes of the key or -1 for null
STOPS = frozenset(".,;:!?")
# Up to here letters are composed already and, but for İ, have one lower case, which does not depend on others.
PLAIN = "\u0250"
OTHER = re.compile("[^\x00-\u012f\u0131-\u024f]").search
# How byte-level vocabularies show the bytes that are no visible character of Latin-1: by further letters, in order.
HIDDEN = [n for n in range(256) if not (33 <= n <= 126 or 161 <= n <= 172 or 174 <= n)]
SHOWN = np.arange(256, dtype="<u2")
SHOWN[HIDDEN] = 256 + np.arange(len(HIDDEN))
SHOWN[32] = 32


class WordEncoder:
    """Token numbers of texts as packed 16-bit integers, word by word.

    For vocabularies that drop white space, read letters in lower case, keep
    them apart from stops, and mark the tokens that end a run. No token then
    reaches over a space or a line end, and a word encoded alone gives the
    numbers it has in the text. Common words are remembered.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_str(model), {"": b""}
        # The merges alone, for words that are in lower case and whole already.
        bare = json.loads(model) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.merges = Tokenizer.from_str(json.dumps(bare))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        suffix = bare["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith(suffix)]] = True

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array("H", x.ids).tobytes() for x in found]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Numbers of words of plain letters: encoded together, cut where runs end."""
        shown = " ".join(words)
        if not shown.isascii():
            shown = SHOWN[np.frombuffer(shown.encode(), np.uint8)].tobytes().decode("utf-16-le")
        found = self.merges.encode_batch_fast([shown], add_special_tokens=False)[0].ids
        numbers = np.array(found, "<u2")
        places = [0, *(2 * np.flatnonzero(self.ends[numbers]) + 2).tolist()]
        data = numbers.tobytes()
        return [data[a:b] for a, b in zip(places, places[1:], strict=False)]

    def _learn(self, words: set[str]) -> None:
        letters, others = [], []
        for w in words:
            (letters if w.islower() and w.isalpha() and (w.isascii() or max(w) < PLAIN) else others).append(w)
        for k in range(0, len(letters), TOGETHER):
            run = letters[k : k + TOGETHER]
            self.known.update(zip(run, self._letters(run), strict=True))
        self.known.update(zip(others, self._one_by_one(others), strict=True))

    def _lower(self, text: str) -> str:
        """The text in lower case, where that changes no numbers."""
        if not text.isascii() and OTHER(text) or any(x in text for x in self.special):
            return text
        return text.lower()

    def _numbers(self, words: list[str]) -> list[bytes]:
        """Numbers of distinct words; those not known are learned first."""
        if len(self.known) > CACHE_WORDS:
            self.known = {"": b""}
        known = self.known
        found = list(map(known.get, words))
        at = [k for k, numbers in enumerate(found) if numbers is None]
        new = [words[k] for k in at]
        heads, stops = [], []  # of each new word, what it is without a stop, and the stop
        for w in new:
            head, stop = (w[:-1], w[-1]) if w[-1] in STOPS and w[:-1].isalpha() else (w, "")
            heads.append(head)
            stops.append(stop)
        wanted = {p for p in chain(heads, stops) if p not in known}
        self._learn(wanted)
        for k, w, head, stop in zip(at, new, heads, stops, strict=True):
            found[k] = known[w] = known[head] + known[stop]
        for w in {w for w in chain(new, wanted) if len(w) > CACHED_CHARS}:
            del known[w]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The numbers of each text: its words as places in the list of distinct ones, whose numbers are then set out."""
        lowered = pa.array([self._lower(text).replace("\n", " ") for text in texts], pa.large_string())
        split = pc.split_pattern(lowered, " ")
        words = split.values.dictionary_encode()
        numbers = self._numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        every = np.frombuffer(b"".join(numbers), "<u2")
        sizes = np.fromiter(map(len, numbers), np.int64, len(numbers)) // 2
        starts = np.cumsum(sizes) - sizes
        word = words.indices.to_numpy()
        size = sizes[word]
        ends = np.concatenate([[0], np.cumsum(size)])
        places = np.repeat(starts[word] - ends[:-1], size) + np.arange(ends[-1])
        data = every[places].tobytes()
        cuts = (2 * ends[split.offsets.to_numpy()]).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def worker_encoder(model: str) -> WordEncoder:
    """The encoder of this worker process; its words serve all tasks that the process runs."""
    held = sys.modules.setdefault("token_store_worker", ModuleType("token_store_worker")).__dict__
    if held.get("model") != model:
        held |= {"model": model, "encoder": WordEncoder(model)}
    return held["encoder"]


def _hashes(key: Column, copy: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a key and the number of its copy."""
    return F.xxhash64(key, copy), F.xxhash64(F.lit("fingerprint"), key, copy)


def _mixed(first: np.ndarray, second: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of both hashes and a displacement (multiply and shift)."""
    x = first ^ (second + seed * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(first: np.ndarray, second: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """The slot of each key, given its block's displacements: a slot for a negative one, else a hash."""
    bucket = (first >> np.uint64(33)) % np.uint64(len(seeds))
    seed = seeds[bucket.astype(np.int64)]
    hashed = _mixed(first, second, seed.astype(np.uint64)) % np.uint64(size)
    return np.where(seed < 0, -seed - 1, hashed.astype(np.int64))


def perfect_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Displacements that send so many different keys to as many slots, one each.

    Buckets of keys are placed by falling size: each takes the first
    displacement that sends all its keys to free slots; single keys are sent
    to what is left by name.
    """
    size = len(first)
    seeds = np.zeros(size // BUCKET_KEYS + 1, np.int64)
    bucket = ((first >> np.uint64(33)) % np.uint64(len(seeds))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
    taken = np.zeros(size, bool)
    tries = np.arange(32, dtype=np.uint64)
    singles = []
    for keys in sorted(groups, key=len, reverse=True):
        if len(keys) == 1:
            singles.append(keys[0])
            continue
        base = np.uint64(0)
        while True:
            seed = (tries + base)[:, None]
            spots = (_mixed(first[keys][None, :], second[keys][None, :], seed) % np.uint64(size)).astype(np.int64)
            apart = np.sort(spots, axis=1)
            good = ~taken[spots].any(axis=1) & (np.diff(apart, axis=1) > 0).all(axis=1)
            if good.any():
                k = int(good.argmax())
                seeds[bucket[keys[0]]] = int(base) + k
                taken[spots[k]] = True
                break
            base += np.uint64(len(tries))
            if base > MOST_TRIES:
                raise ValueError("keys with equal hashes cannot have slots of their own")
    free = np.flatnonzero(~taken)
    for key, slot in zip(singles, free.tolist(), strict=True):
        seeds[bucket[key]] = -slot - 1
    return seeds


def _index(entries: DataFrame) -> DataFrame:
    """One row a block: displacements, then per slot the fingerprint and the entry's fields."""

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = lambda name: table[name].to_numpy()
        first, second = column("first").view(np.uint64), column("second").view(np.uint64)
        seeds = perfect_hash(first, second)
        place = np.empty(len(first), np.int64)
        place[_slots(first, second, seeds, len(first))] = np.arange(len(first))
        packed = {c: [column(c)[place].astype("<i8").tobytes()] for c in ("second", *ENTRY)}
        return pa.table(
            {
                "block": table["block"].slice(0, 1),
                "seeds": pa.array([seeds.astype("<i8").tobytes()], pa.binary()),
                **{c: pa.array(v, pa.binary()) for c, v in packed.items()},
            }
        )

    fields = ", ".join(f"{c} binary" for c in ("second", *ENTRY))
    return entries.groupBy("block").applyInArrow(build, f"block long, seeds binary, {fields}")


ENTRY = ("shard", "place", "start", "tokens", "copies")


@dataclass
class TokenStore:
    """A finished store: where it is, the key's type, and the number of index blocks (0: empty)."""

    spark: SparkSession
    path: str
    key_type: str
    blocks: int

    def locate(self, keys: DataFrame, key: str) -> DataFrame:
        """``key``, ``copy`` and the entry's fields for every stored document of the distinct keys."""
        own = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
        wanted = keys.select(own.alias("key"), F.lit(0).alias("copy")).distinct()
        found = stage(self._probe(wanted), "located")
        more = found.where("copies > 1").select("key", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int") - 1)).alias("copy"))
        return found.unionByName(self._probe(more))

    def _probe(self, keys: DataFrame) -> DataFrame:
        """The entries of (key, copy) pairs; pairs that are not stored fail the fingerprint and go."""
        first, second = _hashes(F.col("key"), F.col("copy"))
        asked = keys.withColumns({"first": first, "second": second})
        asked = asked.groupBy(F.pmod("first", F.lit(max(self.blocks, 1))).alias("block")).agg(
            F.collect_list(F.struct("key", "copy", "first", "second")).alias("asked")
        )
        index = self.spark.read.schema(_index_schema()).parquet(f"{self.path}/index")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    pairs = batch["asked"][row].values
                    a, b = (pairs.field(c).to_numpy().view(np.uint64) for c in ("first", "second"))
                    own = {c: np.frombuffer(batch[c][row].as_py(), "<i8") for c in ("seeds", "second", *ENTRY)}
                    slot = _slots(a, b, own["seeds"], len(own["second"]))
                    kept = np.flatnonzero(own["second"][slot].view(np.uint64) == b)
                    pick = pa.array(kept)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pairs.field("key").take(pick),
                            pairs.field("copy").take(pick),
                            *[pa.array(own[c][slot[kept]], pa.int64()) for c in ENTRY],
                        ],
                        names=["key", "copy", *ENTRY],
                    )

        fields = ", ".join(f"{c} long" for c in ENTRY)
        return asked.join(index, "block").drop("block").mapInArrow(run, f"key string, copy int, {fields}")

    def fetch(self, keys: DataFrame, key: str = "doc_id") -> DataFrame:
        """``doc_id``, ``start``, ``n_tokens`` and ``ids`` of every stored document with one of the keys.

        Each key is looked up in constant time: its block, its displacement,
        its slot, and a fingerprint that turns unknown keys away (an unknown
        key passes once in 2^64). The places found travel to the shards, and
        tasks read just those ranges of the raw files; payloads are not
        shuffled. ``start`` counts the numbers of all documents before;
        ``ids``, as little-endian unsigned 32-bit integers, ends in the end
        number. Repeated keys ask once; a key stored several times gives each
        of its documents; null is a key like any other.
        """
        places = self.locate(keys, key).groupBy("shard").agg(
            F.sort_array(F.collect_list(F.struct("place", "tokens", "start", "key"))).alias("wanted")
        )
        if self.blocks:
            raw = self.spark.read.format("binaryFile").load(f"{self.path}/ids/kind=ids")
            files = raw.select(_shard_of("path").alias("shard"), "path")
        else:
            files = self.spark.createDataFrame([], "shard long, path string")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, wanted in zip(batch["path"], batch["wanted"], strict=True):
                    yield from _read(path.as_py(), wanted.values)

        read = places.join(files, "shard").select("path", "wanted")
        read = read.mapInArrow(run, "key string, start long, n_tokens long, ids binary")
        own = F.when(F.col("key") != "", F.substring("key", 2, 2**31 - 1)).cast(self.key_type)
        return read.select(own.alias("doc_id"), "start", "n_tokens", "ids")


def _index_schema() -> str:
    return "block long, seeds binary, " + ", ".join(f"{c} binary" for c in ("second", *ENTRY))


def _shard_of(path: str) -> Column:
    return F.regexp_extract(path, r"shard=(\d+)", 1).cast("long")


def _open(path: str):
    """A raw file of the store, wherever Spark wrote it, for reads at any place."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, inside = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_input_file(inside)


def _read(path: str, wanted: pa.StructArray) -> Iterator[pa.RecordBatch]:
    """The wanted ranges of one file, in its order, some MB at a time; neighbours are read together."""
    place, tokens = (wanted.field(c).to_numpy() for c in ("place", "tokens"))
    first = 0
    with _open(path) as file:
        while first < len(place):
            ends = place[first:] + tokens[first:]
            apart = np.flatnonzero((place[first + 1 :] != ends[:-1]) | (2 * (ends[1:] - place[first]) > BATCH_BYTES))
            last = first + 1 + (int(apart[0]) if len(apart) else len(ends) - 1)
            data = np.frombuffer(file.read_at(2 * int(ends[last - first - 1] - place[first]), 2 * int(place[first])), "<u2")
            wide = data.astype("<u4").tobytes()
            at = (4 * (place[first:last] - place[first])).tolist()
            upto = (4 * (ends[: last - first] - place[first])).tolist()
            run = wanted.slice(first, last - first)
            yield pa.RecordBatch.from_arrays(
                [run.field("key"), run.field("start"), run.field("tokens"), pa.array([wide[a:b] for a, b in zip(at, upto, strict=True)], pa.binary())],
                names=["key", "start", "n_tokens", "ids"],
            )
            first = last


def _encoded(ordered: DataFrame, model: str, end_id: int) -> DataFrame:
    """For every document its numbers and its record, as rows of kind, shard, at and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, at = worker_encoder(model), TaskContext.get().partitionId(), 0

        def out(keys: list[str | None], texts: list[str]) -> pa.RecordBatch:
            kinds, values = [], []
            for key, numbers in zip(keys, encoder.encode(texts), strict=True):
                coded = b"" if key is None else key.encode()
                kinds += ["ids", "docs"]
                values += [numbers, struct.pack(RECORD, len(numbers) // 2 + 1, -1 if key is None else len(coded)) + coded]
            places = np.repeat(np.arange(at, at + len(keys)), 2)
            return pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(np.full(len(kinds), shard, np.int32)), pa.array(places), pa.array(values, pa.binary())],
                names=["kind", "shard", "at", "value"],
            )

        for batch in batches:
            keys, texts, size = [], [], 0
            for key, text in zip(batch["key"], batch["text"], strict=True):
                keys.append(key.as_py())
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size > BATCH_CHARS:
                    yield out(keys, texts)
                    at, keys, texts, size = at + len(keys), [], [], 0
            if keys:
                yield out(keys, texts)
                at += len(keys)

    return ordered.mapInArrow(run, "kind string, shard int, at long, value binary")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """``shard``, ``at``, ``key``, ``place`` and ``tokens`` of every document, from the lists beside the raw files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch["shard"], batch["content"], strict=True):
                data, at, sizes, keys = content.as_py(), 0, [], []
                while at < len(data):
                    tokens, length = struct.unpack_from(RECORD, data, at)
                    at += struct.calcsize(RECORD)
                    keys.append("" if length < 0 else "=" + data[at : at + length].decode())
                    sizes.append(tokens)
                    at += max(length, 0) + 2  # the end number follows every row
                tokens = np.array(sizes, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(keys), shard.as_py(), np.int64)),
                        pa.array(np.arange(len(keys))),
                        pa.array(keys, pa.string()),
                        pa.array(np.cumsum(tokens) - tokens),
                        pa.array(tokens),
                    ],
                    names=["shard", "at", "key", "place", "tokens"],
                )

    lists = spark.read.format("binaryFile").load(f"{path}/ids/kind=docs")
    return lists.select(_shard_of("path").alias("shard"), "content").mapInArrow(
        run, "shard long, at long, key string, place long, tokens long"
    )


def write_tokens(
    docs: DataFrame, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES
) -> TokenStore:
    """Encode whole texts and write them, with an index, to a new folder under the shared one.

    Texts are sorted by key over the cluster (null keys first, rows of one key
    by length and hash of their text) and encoded where they then lie; a shard
    is one task's range, about ``shard_bytes`` of text. Spark's own text writer
    appends the raw numbers, 16 bits each, little-endian; the line end that it
    puts after every document is the end number. The index is made from what
    was written: a perfect hash for every block of about 1,024 keys, whose
    slots hold a fingerprint and the document's place; block by block, all
    slots together are as many as documents. Vocabularies of more than 65,536
    numbers, and patterns that keep white space, are not for this format.

    A null text is an empty one: just the end number. Repeated rows each come
    out; a key's documents are told apart by a copy number. Other columns are
    not read, whatever their names. No rows give an empty store. A very long
    text makes its shard longer and is never cut.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as file:
        model = file.read()
    path = new_path(spark, "tokens")
    slim = docs.select(
        F.col(doc_id).alias("order"),
        F.col(doc_id).cast("string").alias("key"),
        F.octet_length(text).alias("size"),
        F.xxhash64(text).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
        F.col(text).cast("string").alias("text"),
    )
    weight = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    by = ["order", "size", "digest", "row"]
    ordered = slim.repartitionByRange(weight // shard_bytes + 1, *by).sortWithinPartitions(*by)
    written = _encoded(ordered.select("key", "text"), model, end_id).sortWithinPartitions("kind", "shard", "at")
    (
        written.select(F.col("value").cast("string").alias("value"), "kind", "shard")
        .write.partitionBy("kind", "shard")
        .option("lineSep", struct.pack("<H", end_id).decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .option("compression", "none")
        .text(f"{path}/ids")
    )
    key_type = docs.schema[doc_id].dataType.simpleString()
    if not weight:
        spark.createDataFrame([], _index_schema()).write.parquet(f"{path}/index")
        return TokenStore(spark, path, key_type, 0)
    listed = stage(_documents(spark, path), "listed")
    shards = listed.groupBy("shard").agg(F.sum("tokens").alias("sum_"), F.count(F.lit(1)).alias("rows_"))
    before = "PARTITION BY 0 ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    shards = shards.select(
        "shard",
        F.expr(f"coalesce(sum(sum_) OVER ({before}), 0)").alias("sum_before"),
        F.expr(f"coalesce(sum(rows_) OVER ({before}), 0)").alias("rows_before"),
    )
    placed = listed.join(shards, "shard").select(
        "key", "shard", "place", "tokens",
        (F.col("sum_before") + F.col("place")).alias("start"),
        (F.col("rows_before") + F.col("at")).alias("position"),
    )
    repeated = placed.groupBy("key").agg(F.min("position").alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    first, second = _hashes(F.col("key"), F.col("copy"))
    entries = (
        placed.join(repeated, "key", "left")
        .withColumn("copy", F.coalesce(F.col("position") - F.col("least"), F.lit(0)).cast("int"))
        .withColumn("copies", F.coalesce("copies", F.lit(1)))
        .withColumns({"first": first, "second": second})
    )
    blocks = listed.count() // BLOCK_KEYS + 1
    keyed = entries.select(F.pmod("first", F.lit(blocks)).alias("block"), "first", "second", *ENTRY)
    _index(keyed).sortWithinPartitions("block").write.parquet(f"{path}/index")
    return TokenStore(spark, path, key_type, blocks)
