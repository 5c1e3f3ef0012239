"""The token store against the tokenizers library, and its index by itself."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_llm_operators import texts
from tokenizers import Tokenizer

from retail_insight.llm import token_store
from retail_insight.llm.token_store import perfect_hash, write_tokens

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, key string, shard int, START long, place string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def expected(library, rows):
    """Rows by id, and within an id by length and Spark's hash; start is only certain where ids are unique."""
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
    return [(i, ids(t)) for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]


def odd_texts():
    return texts() + ["İstanbul ΣΑΣ é e\u0301 \u0301x", "a\tb\rc\x0bd\x1ce\u2003f", "don't I'LL we're 12 3,4.", "<|endoftext|>.x", "stop. stop, STOP! ünï; 日本. ..", "x\u0301."]


@pytest.mark.parametrize("shard_bytes", [20_000, 1 << 25])
def test_store_against_the_library(spark, library, shard_bytes, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_KEYS", 16)
    rows = [(i * 37 % 1009, t) for i, t in enumerate(odd_texts())]
    docs = spark.createDataFrame([(*r, "k", 1, 2, "p") for r in rows], SCHEMA).repartition(3)
    store = write_tokens(docs, VOCABULARY, 1, shard_bytes=shard_bytes)
    found = store.fetch(docs.select("doc_id")).orderBy("doc_id").collect()
    want = expected(library, rows)
    assert [(r.doc_id, bytes(r.ids)) for r in found] == want
    sizes = np.array([len(x) // 4 for _, x in want])
    assert [r.n_tokens for r in found] == sizes.tolist()
    assert [r.start for r in found] == (np.cumsum(sizes) - sizes).tolist()


def test_null_and_repeated_keys_and_keys_that_are_not_there(spark, library):
    rows = [(3, "same text")] * 30 + [(3, "other"), (None, "no id"), (None, None), (None, ""), (1, "first"), (9, "last")]
    docs = spark.createDataFrame([(*r, "k", 1, 2, "p") for r in rows], SCHEMA).repartition(4)
    store = write_tokens(docs, VOCABULARY, 1, shard_bytes=300)
    found = store.fetch(docs).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in found) == Counter(expected(library, rows))
    starts = sorted((r.start, r.n_tokens) for r in found)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    some = spark.createDataFrame([(9,), (9,), (77,), (1,), (-5,)], "doc_id long")
    assert sorted(r.doc_id for r in store.fetch(some).collect()) == [1, 9]


def test_text_keys(spark, library):
    rows = [("b\x01\x00é", "one two"), ("", "empty key"), (None, "null key"), ("=", "x"), ("ü", "y")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = write_tokens(docs, VOCABULARY, 1).fetch(docs).collect()
    ids = lambda t: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()
    assert {(r.doc_id, bytes(r.ids)) for r in found} == {(i, ids(t)) for i, t in rows}


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert write_tokens(docs, VOCABULARY, 1).fetch(docs).count() == 0


def test_raw_files_are_the_numbers_in_order(spark, library):
    rows = [(i, f"word{i} and more. text {i * i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    store = write_tokens(docs, VOCABULARY, 1, shard_bytes=1_000)
    files = spark.read.format("binaryFile").load(f"{store.path}/ids/kind=ids").orderBy("shard").collect()
    assert len(files) > 1
    flat = np.frombuffer(b"".join(f.content for f in files), "<u2")
    assert flat.tolist() == [x for _, t in rows for x in [*library.encode(t, add_special_tokens=False).ids, 1]]


@pytest.mark.parametrize("size", [1, 2, 3, 10, 1_000, 5_000])
def test_perfect_hash_is_minimal(size):
    rng = np.random.default_rng(size)
    first, second = (rng.integers(0, 2**64, size, dtype=np.uint64) for _ in range(2))
    first[: size // 100] = first[-(size // 100) :][: size // 100]  # equal first hashes are told apart by the second
    slots = token_store._slots(first, second, perfect_hash(first, second), size)
    assert sorted(slots.tolist()) == list(range(size))


def test_crc_of_the_query(spark, library):
    from retail_insight.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want, start = [], 0
    for i, ids in expected(library, [tuple(r) for r in docs]):
        want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(map(tuple, QUERIES["op12_token_store"](spark, sf).collect())) == want


def test_a_distinct_word_is_looked_up_once_a_batch():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        model = file.read()
    encoder, library = token_store.WordEncoder(model), Tokenizer.from_str(model)
    texts = ["one two. " * 500, "", "zwei  für\nfür " * 500, "two."]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    encoder.known = Counted(encoder.known)
    assert encoder.encode(texts) == want
    assert Counted.asked < 50
