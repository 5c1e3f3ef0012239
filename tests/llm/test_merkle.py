"""The Merkle manifest against a tree built level by level in memory."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from retail_insight.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, position int, tree string, LEAF string, block int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def levels_of(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([digest(*found[-1][k : k + 2]) for k in range(0, len(found[-1]), 2)])
    return found


def siblings(levels, place):
    for level in levels[:-1]:
        other = place ^ 1
        yield (other & 1, level[other]) if other < len(level) else None
        place //= 2


def expected(rows):
    trees = {}
    for row in rows:
        trees.setdefault((row[2] is not None, (row[2] or "").encode()), []).append(row)
    built = {}
    for key, held in trees.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        built[key] = levels_of([leaf_of(r) for r in held])
    order = sorted(built)
    upper = levels_of([built[k][-1][0] for k in order]) if order else []
    out = []
    for key, held in trees.items():
        for place, row in enumerate(held):
            steps = [*siblings(built[key], place), *siblings(upper, order.index(key))]
            told = list(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                told[3] += 1
            h = leaf_of(told)
            for s in steps:
                h = digest(h) if s is None else digest(h, s[1]) if s[0] else digest(s[1], h)
            out.append((row[0], leaf_of(row), built[key][-1][0], upper[-1][0], "".join(s[1] for s in steps if s), h))
    return out


def proved(docs):
    chosen = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    longer = F.when(chosen, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.prove(merkle.build_manifest(docs, FIELDS, claimed={"n_chars": longer}))
    return found.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root")


def some_rows():
    rng = random.Random(8)
    rows = [(i * 7 % 401, rng.choice(["a", None, ""]), "en", i, f"text {i}") for i in range(150)]
    rows += [(i, "s", lang, None, None) for lang in (None, "", "é", "z", "Z", "𝒳") for i in range(rng.randint(1, 23))]
    rows += [(None, "s", "en", 1, "x"), (None, None, "en", 1, "x"), (5, "s", "one", 1, "x" * 300_000)]
    return rows + [(3, "s", "en", 4, "same")] * 40 + [(3, "s", "en", 4, "other")] * 3


@pytest.mark.parametrize("levels", [1, 2, 3, 12])
def test_proofs_against_a_tree_in_memory(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 1 << levels)
    rows = some_rows()
    docs = spark.createDataFrame([(*r, 1, "t", "l", 2) for r in rows], SCHEMA).repartition(3)
    assert Counter(map(tuple, proved(docs).collect())) == Counter(expected(rows))


def test_tampering_is_found_and_nothing_else(spark):
    rows = [(i, "s", "en", None if i % 5 == 0 else i, "t") for i in range(300)]
    docs = spark.createDataFrame([(*r, 1, "t", "l", 2) for r in rows], SCHEMA)
    bad = {r.doc_id for r in proved(docs).collect() if r.root != r.folded_root}
    assert bad == {i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 0 and i % 5}


def test_no_rows_and_one_row(spark):
    none = spark.createDataFrame([], SCHEMA)
    manifest = merkle.build_manifest(none, FIELDS)
    assert manifest.root() is None and merkle.prove(manifest).count() == 0
    one = spark.createDataFrame([(1, None, None, None, None, 1, "t", "l", 2)], SCHEMA)
    manifest = merkle.build_manifest(one, FIELDS)
    (row,) = merkle.prove(manifest).collect()
    assert row.leaf == row.root == row.folded_root == manifest.root() == leaf_of((1, None, None, None, None))
    assert row.proof == ""


@pytest.mark.parametrize("levels", [0, 1, 2, 5])
def test_places_in_the_log(levels):
    for count in range(1, (1 << levels) + 1):
        leaves = [digest(str(k)) for k in range(count)]
        log, row = merkle.append_log(leaves, levels), leaves
        for level in range(levels + 1):
            assert [log[merkle.log_place(level, k, count)] for k in range(len(row))] == row
            row = [digest(*row[k : k + 2]) for k in range(0, len(row), 2)]
        assert len(log) == len(set(merkle.log_place(v, k, count) for v in range(levels + 1) for k in range(-(-count >> v))))
