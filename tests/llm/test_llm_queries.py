"""The registered queries of the training-text operators, and the pipeline."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from compare import compare, connect
from pyspark.sql import functions as F
from test_llm_operators import components, fingerprint, library, lowered

from retail_insight.llm.queries import ORACLE, QUERIES
from retail_insight.llm.source_mix import mix_sources
from retail_insight.sources.workspace import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, SF) is None


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_pipeline_against_brute_force(spark):
    import numpy as np

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {name: None for name, _ in corpus_pipeline.STAGES}
    before = docs
    for name, step in corpus_pipeline.STAGES:
        after = stage(step(spark, before, SF), "pipeline-test")
        if name != "byte-level bpe":
            assert after.columns == docs.columns
        rows, kept[name] = before.select("doc_id", "text").collect(), after
        if name == "exact dedup":
            best = {}
            for i, t in rows:
                best[lowered(t)] = max(best.get(lowered(t), -1), i)
            assert {r.doc_id for r in after.collect()} == set(best.values())
        if name == "simhash near-dedup":
            groups = components([fingerprint(t) for _, t in rows], [i for i, _ in rows])
            assert {r.doc_id for r in after.collect()} == set(groups)
        if name == "source mix":
            size = {r.doc_id: (r["size"], r.taken) for r in mix_sources(before).collect()}
            got = {}
            for r in after.collect():
                got[r.doc_id] = got.get(r.doc_id, 0) + 1
            assert all(abs(n * size[i][0] - size[i][1]) <= size[i][0] / 2 for i, n in got.items())
            assert all(size[i][1] * 2 < size[i][0] or not size[i][0] for i in set(size) - set(got))
        if name == "byte-level bpe":
            own = library("byte_bpe_multi_50k.tiktoken")[1]
            want = sorted(
                (i, len(ids := own.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                 hashlib.sha256((t or "").encode()).hexdigest())
                for i, t in rows
            )
            assert sorted(tuple(r) for r in after.collect()) == want
        before = after
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = labels.where("quality = 1").join(docs, "doc_id").count()
    assert kept["quality classifier"].join(labels.where("quality = 1"), "doc_id").count() >= 0.98 * good
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, before.collect()))


def test_pipeline_mix_of_null_and_repeated_ids(spark):
    text = lambda n, k: " ".join(f"w{n}x{j}" for j in range(k))
    rows = [(None, text(i, 10 + i), "a") for i in range(20)] + [(7, text(i, 10 + i), "b") for i in range(20, 40)]
    rows += [(8, text(99, 12), "a")] * 3 + [(None, "", "a"), (None, None, None), (9, text(50, 4), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    share = Counter()
    for r in mix_sources(docs.withColumn("t", F.col("text")), carried=["t"]).collect():
        share[(r.doc_id, r.t)] += (r.taken * 2 + r["size"]) // (r["size"] * 2) if r["size"] else 0
    found = corpus_pipeline.mix(spark, docs, SF)
    assert found.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in found.collect())
    assert got == +share and any(i is None for i, _ in got) and len({n for (i, _), n in got.items() if i == 7}) > 1


def test_pipeline_dedup_of_null_and_repeated_ids(spark):
    text = lambda n: " ".join(f"w{n}x{j}" for j in range(60))
    near = lambda n: text(n) + " ."
    rows = [(1, text(1))] * 3 + [(None, text(2))] * 3 + [(None, text(3)), (5, text(3)), (5, text(3)), (4, text(3))]
    rows += [(6, text(6)), (6, text(7)), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = corpus_pipeline.keep_distinct(spark, docs, SF)
    assert found.columns == docs.columns
    got = Counter((r.doc_id, r.text or "") for r in found.collect())
    assert got == Counter([(1, text(1)), (None, text(2)), (5, text(3)), (6, text(6)), (6, text(7)), (None, "")])

    assert len(components([fingerprint(text(n)) for n in range(1, 6)], range(1, 6))) == 5
    rows = [(1, text(1))] * 2 + [(None, text(2))] * 2 + [(9, text(3)), (None, near(3)), (8, text(4)), (9, text(4)), (9, text(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.keep_representatives(spark, docs, SF).collect()
    prints = {n: fingerprint(t) for n, t in ((3, text(3)), ("3n", near(3)))}
    third = [(9, text(3))] + [(None, near(3))] * ((prints[3] ^ prints["3n"]).bit_count() > 4)
    assert Counter(map(tuple, got)) == Counter([(1, text(1)), (None, text(2)), *third, (8, text(4)), (9, text(5))])
