"""Training-text operators against brute force, on small tables with every odd case."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from retail_insight.llm import byte_bpe, html_text, quality, simhash, source_mix, suffix_dedup, topk
from retail_insight.llm.exact_dedup import exact_dedup
from retail_insight.llm.html_text import blocks_of, extract_text
from retail_insight.llm.quality import classify_quality
from retail_insight.llm.secret_scan import FEATURES, scan_secrets
from retail_insight.llm.source_mix import mix_sources
from retail_insight.llm.suffix_dedup import repeated_bytes
from retail_insight.llm.token_counts import count_tokens
from retail_insight.llm.topk import top_k

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "KEEP_ID string, salt int, score string, size int, chunk string, fp int, tokens string"
)
WORDS = "the of and Über naïve don't x1 2024 12,5   日本 𝒳 <|endoftext|> a--b é Ab aB \t \n\n".split(" ")


def texts():
    rng = random.Random(4)
    out = [None, "", " ", "\n", "A", "a", "The Of", "the of", "<|endoftext|>", "a <|endoftext|>b", "\u0085 x  　y"]
    base = [" ".join(rng.choice(WORDS) for _ in range(120)) for _ in range(6)]
    out += base + base[:3] + [b.upper() for b in base[:2]]
    out += [b + " tail" for b in base] + [b[:200] + "Z" + b[201:] for b in base]
    out += ["x" * 40_000, "ab " * 9_000, base[0] * 30, base[0][20:90], base[0][20:69]]
    return out


@pytest.fixture(scope="module")
def rows():
    found = [(i * 3 % 101, t) for i, t in enumerate(texts())]
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    more = [
        (i, t, "en" if i % 2 else None, f"s{i % 4}" if i % 5 else None, len(t or ""), "k", 1, "s", 2, "c", 3, "t")
        for i, t in rows
    ]
    return spark.createDataFrame(more, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *columns).collect()}


def lowered(text):
    return (text or "").encode().lower()  # of bytes: A-Z only


# --- exact dedup ---------------------------------------------------------------


@pytest.mark.parametrize("bits", [16, 1 << 20])
def test_exact_dedup(docs, rows, empty, bits):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    want = {
        i: (max(groups[lowered(t)]), len(groups[lowered(t)]), max(groups[lowered(t)]) == i, hashlib.sha256(lowered(t)).hexdigest())
        for i, t in rows
    }
    found = exact_dedup(docs, bits_per_row=bits, max_filter_bits=1 << 16)
    assert by_id(found, "keep_id", "group_size", "kept", "text_sha256") == want
    assert "salt" in found.columns and "KEEP_ID" not in found.columns
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_null_and_repeated_ids(spark):
    some = spark.createDataFrame(
        [(None, "a"), (1, "A"), (1, "a"), (None, "b"), (None, "b")], "doc_id long, text string"
    )
    found = Counter((r.doc_id, r.text, r.keep_id, r.group_size, r.kept) for r in exact_dedup(some).collect())
    assert found == Counter(
        [(None, "a", 1, 3, False), (1, "A", 1, 3, True), (1, "a", 1, 3, True)] + 2 * [(None, "b", None, 2, True)]
    )


# --- byte-level BPE --------------------------------------------------------------


def library(name):
    ranks = byte_bpe.read_ranks(public_tokenizers.path(name))
    return ranks, tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


@pytest.mark.parametrize("chunk", [4 << 20, 3_000])
def test_byte_bpe(docs, rows, empty, chunk, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(byte_bpe, "RANGE_BYTES", chunk * 2)
    ranks, own = library("byte_bpe_multi_50k.tiktoken")
    want = {}
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        want[i] = (len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode())
    one_pass = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    found = {k: (n, bytes(a), bytes(b)) for k, (n, a, b) in by_id(one_pass, "n_tokens", "ids", "decoded").items()}
    assert found == want
    apart = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    assert {k: bytes(v[0]) for k, v in by_id(apart, "decoded").items()} == {k: v[2] for k, v in want.items()}
    assert byte_bpe.encode(empty, ranks, public_tokenizers.PATTERN, decoded=True).count() == 0


def test_byte_bpe_repeated_and_null_ids(spark):
    ranks, own = library("byte_bpe_multi_50k.tiktoken")
    some = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    found = Counter((r.doc_id, r.n_tokens) for r in byte_bpe.encode(some, ranks, public_tokenizers.PATTERN).collect())
    assert found == Counter({(1, len(own.encode_ordinary("a b"))): 2, (None, 0): 1})


# --- token counts ------------------------------------------------------------------


@pytest.mark.parametrize("size", [65_536, 3])
def test_token_counts(docs, rows, empty, size):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    want = {}
    for i, t in rows:
        n = len(own.encode(t or "", add_special_tokens=False).ids)
        want[i] = (len((t or "").encode()), n, n > 1024)
    found = count_tokens(docs, path, public_tokenizers.PATTERN, table_size=size)
    assert by_id(found, "n_bytes", "n_tokens", "over_limit") == want
    assert count_tokens(empty, path, public_tokenizers.PATTERN).count() == 0


# --- mixing ----------------------------------------------------------------------------


def targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    """Share by weight, stop at the cap, share what is left again, until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    found, left, open_sources = {}, share * sum(sizes.values()), set(order)
    while open_sources:
        per = left / sum(weight[s] for s in open_sources)
        above = {s for s in open_sources if per * weight[s] > epochs * sizes[s]}
        if not above:
            return found | {s: per * weight[s] for s in open_sources}
        found |= {s: epochs * sizes[s] for s in above}
        left -= sum(epochs * sizes[s] for s in above)
        open_sources -= above
    return found


@pytest.mark.parametrize("weights", [(5, 2, 1), (1,), (1, 50, 2)])
def test_mix_sources(docs, rows, empty, weights, monkeypatch):
    monkeypatch.setattr(source_mix, "ROWS_PER_RANGE", 5)
    monkeypatch.setattr(source_mix, "RANGES_PER_SPAN", 3)
    found = mix_sources(docs, weights=weights).collect()
    size = {i: len((t or "").encode().split()) for i, t in rows}
    totals = Counter()
    for r in docs.collect():
        totals[r.source] += size[r.doc_id]
    want = targets(totals, weights)
    taken = Counter()
    for r in found:
        assert r["size"] == size[r.doc_id] and r.source_size == totals[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-12)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(taken[s] == math.floor(want[s] + 1e-9) for s in want)
    assert len(found) == len(rows)
    again = mix_sources(docs.repartition(5), weights=weights)
    assert {(r.doc_id, r.taken) for r in again.collect()} == {(r.doc_id, r.taken) for r in found}
    assert mix_sources(empty).count() == 0


# --- HTML ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<article></article>", ""),
        ("<nav>m</nav><article><h1>A &amp; B</h1><p><b>x\n  y<br><p>z&nbsp;w</p></article><footer>f</footer>", "A & B\nx y\nz w"),
        ('<article><p>a</p><div class="comments"><p>c</p></div><p>b</p></article>', "a\nb"),
        ('<article><script>var t="</p>";</script><style>p{}</style><!-- <p>c</p> --><p>a&lt;b</p></article>', "a<b"),
        ('<main><p>a</p><aside>s</aside><form><p>f</p></form></main><div id="cookie-notice">n</div>', "a"),
        ("<body><header>h</header><p>one <i>two</i></p><ul><li>k</li></ul></body>", "one two\nk"),
        ("<article><p>a &#233;&#x41; &copy</article>", "a éA ©"),
        ("plain < text", "plain < text"),
    ],
)
def test_blocks(page, want):
    assert "\n".join(blocks_of(page)[0]) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="layout no-sidebar"><article><p>a</p></article></div>', "a"),
        ('<div class="sidebar"><article><p>a</p></article></div>', "a"),
        ('<form class="widget"><main><p>a</p></main></form><article>t</article>', "a\nt"),
        ("<div class=widget><div role=main>a</div></div><p>b</p>", "a"),
        ('<article><h2 id="related-work">A</h2><p>a</p><h3 id="market-share">B</h3><h2 id="related">C</h2></article>', "A\na\nB\nC"),
        ('<article><p data-id="ad" data-role="navigation">a</p><p aria-label="class=ad">b</p></article>', "a\nb"),
        ('<article><p>a</p><div class="x ad">n</div><p id=\'share\'>n</p><p ROLE=navigation>n</p></article>', "a"),
        ("<html><head><title>t</title><meta charset=utf-8><body><p>a</p></body></html>", "a"),
        ("<head><title>t</title><article><p>a</p></article>", "a"),
        ("<head><title>t</title>\nplain <b>text</b>", "plain text"),
        ("<head><title>t</title></head><body><p>a</p>", "a"),
        ('<div>text</div><section class="comments"><article>c</article></section>', "text"),
        ('<div>a long text of the page</div><div class="widget"><article>t</article></div>', "a long text of the page\nt"),
    ],
)
def test_names_are_whole_and_the_article_stays(page, want):
    assert "\n".join(blocks_of(page)[0]) == want


def test_extract_text_removes_repeats_of_the_host(spark):
    menu = "<div>home news sport weather travel money more search now</div>"
    body = lambda n: f"<p>{' '.join(f'w{n}x{k}' for k in range(12))}</p>"
    pages = [(i, f"http://h{i % 2}.example/{i}", f"<body>{menu if i < 4 else ''}{body(i)}</body>") for i in range(6)]
    pages += [(7, None, None), (8, "http://h0.example/8", f"<article>{menu}</article>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in extract_text(frame).collect()}
    assert found[0] == " ".join(f"w0x{k}" for k in range(12)) and found[5].startswith("w5x0")
    assert "home" not in found[1] and found[7] == "" and found[8].startswith("home news")
    assert extract_text(frame.limit(0)).count() == 0
    assert all(r.n_chars == len(r.text) for r in extract_text(frame).collect())


def test_extract_text_checks_repeats_in_named_articles(spark):
    text = lambda n: " ".join(f"w{n}x{k}" for k in range(12))
    notice = "read more of our stories every day with the new app"
    quote = "a passage that a few pages of this host quote in full length"

    def page(n):
        quoted = f"<p>{quote}</p>" if n < 4 else ""
        return f"<article><p>{text(n)}</p>{quoted}<p>{notice}</p><p>{text(n + 100)} {notice}</p></article><footer>{text(n + 200)}</footer>"

    pages = [(n, "http://a.example/", page(n)) for n in range(12)] + [(50, "http://a.example/", page(0))]
    pages += [(20 + n, "http://b.example/", page(n)) for n in range(5)]  # too few contents to tell
    pages += [(40, "http://a.example/", f"<div>{quote}</div><div>{text(40)}</div>")]  # names no article
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    found = {r.page_id: r.text for r in extract_text(frame).collect()}
    want = lambda n, *more: "\n".join([text(n), *([quote] if n < 4 else []), *more, f"{text(n + 100)} {notice}"])
    assert found == {n: want(n) for n in range(12)} | {20 + n: want(n, notice) for n in range(5)} | {40: text(40), 50: want(0)}


def test_extract_text_keeps_copies_and_repeated_rows(spark):
    menu = "<div>home news sport weather travel money more search now</div>"
    body = lambda n: f"{menu}<p>{' '.join(f'w{n}x{k}' for k in range(12))}</p>"
    text = lambda n: " ".join(f"w{n}x{k}" for k in range(12))
    pages = [(1, "http://a.example/1", body(1))] * 3  # repeated rows
    pages += [(i, f"http://a.example/{i}", f"<body>{body(2)}</body>") for i in (2, 3)]  # a page that was read twice
    pages += [(i, f"http://b.example/{i}", body(4)) for i in (4, 5)]  # the only content of its host
    pages += [(6, "http://c.example/6", body(1)), (7, None, body(7)), (7, None, body(7)), (8, "http://a.example/8", "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    found = Counter((r.page_id, r.text) for r in extract_text(frame).collect())
    whole = lambda n: "home news sport weather travel money more search now\n" + text(n)
    want = Counter({(1, text(1)): 3, (2, text(2)): 1, (3, text(2)): 1, (4, whole(4)): 1, (5, whole(4)): 1})
    assert found == want + Counter({(6, whole(1)): 1, (7, whole(7)): 2, (8, ""): 1})


# --- repeated bytes ----------------------------------------------------------------------


def cut(rows, length=50):
    ordered = sorted(((math.inf if i is None else i, (t or "").encode()) for i, t in rows), key=lambda x: x[0])
    first = {}
    for i, data in ordered:
        for p in range(len(data) - length + 1):
            first.setdefault(data[p : p + length], i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < (math.inf if i is None else i):
                gone[p : p + length] = True
        turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
        out.append((i, len(data), int(gone.sum()), len(turns) // 2, np.frombuffer(data, np.uint8)[~gone].tobytes()))
    return Counter(out)


@pytest.mark.parametrize(("chunk", "names"), [(4 << 20, 1_000_000), (2_000, 400)])
def test_repeated_bytes(docs, rows, empty, chunk, names, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix_dedup, "NAMES_PER_RANGE", names)
    found = repeated_bytes(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == cut(rows)
    assert all(sum(e - s for s, e in r.spans) == r.n_removed for r in found)
    assert repeated_bytes(empty).count() == 0


def test_repeated_bytes_null_and_equal_ids(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(70))
    some = [(None, text + "x"), (5, text), (5, text), (5, "y" + text), (9, text), (None, None), (2, "short")]
    found = repeated_bytes(spark.createDataFrame(some, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == cut(some)


@pytest.mark.parametrize("bits", [32, 41, 64])
@pytest.mark.parametrize("ranges", [1, 7, 3_000_000, 1 << 31])
def test_names_by_range(bits, ranges):
    """Every name in the one range of its leading bits, and ranges without names not visited."""
    draw = random.Random(bits)
    for n in (0, 1, 3000):
        names = sorted({draw.randrange(1 << bits) for _ in range(n)} | ({0, (1 << bits) - 1} if n > 1 else set()))
        found = list(suffix_dedup._ranges(np.array(names, np.uint64), bits, ranges))
        wanted = {}
        for name in names:
            wanted.setdefault((name >> (bits - 32)) * ranges >> 32, []).append(name)
        assert {r: names[part] for r, part in found} == wanted and len(found) == len(wanted)


@pytest.mark.parametrize("modulus", suffix_dedup.COVERS)
def test_difference_covers(modulus):
    cover = suffix_dedup.COVERS[modulus]
    assert {(a - b) % modulus for a in cover for b in cover} == set(range(modulus))


# --- top k -----------------------------------------------------------------------------------


def test_top_k(spark):
    rng = random.Random(8)
    vectors = [(i, [rng.choice([-1.5, 0.0, 0.25, rng.random()]) for _ in range(5)]) for i in range(-40, 160)]
    vectors += [(400, None), (420, [1.0, None]), (440, [float("nan")] * 5), (460, [float("inf")] * 5), (480, [2.0]), (500, [])]
    vectors += [(520, [0.5] * 5)] * 2 + [(None, [1.0] * 5)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    usable = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable[i] = [math.floor(64 * x) for x in v]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    want = set()
    for q in (i for i in usable if i % 20 == 0):
        ranked = sorted(((-dot(usable[q], usable[i]), i) for i in usable if i != q))[:20]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked)}
    for sizes in ({}, {"block_rows": 64, "batch_queries": 3}):
        assert {tuple(r) for r in top_k(frame, **sizes).collect()} == want
    assert top_k(frame.limit(0)).count() == 0
    few = top_k(frame.where("vec_id IN (0, 20, 480, 500)")).collect()
    assert Counter(r.query_id for r in few) == {0: 3, 20: 3, 480: 3, 500: 3}


def test_top_k_of_large_vectors(spark):
    rng = random.Random(9)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(-20, 60)]
    vectors += [(100, [262144.0, 0.5]), (101, [-262144.0] * 6), (120, [3e7, -5e6, 1.0]), (121, [1e15, -1e15, 3.0, 1e-3])]
    vectors += [(140, [-1e300, 2.0]), (141, [1.7e308, -1.7e308]), (160, [6e8] * 2000), (161, [2.0**22] * 2000), (180, [])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    whole = {i: [math.floor(64 * x) if abs(x) < 1e300 else 64 * int(x) for x in v] for i, v in vectors}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    want = set()
    for q in (i for i in whole if i % 20 == 0):
        ranked = sorted((-dot(whole[q], whole[i]), i) for i in whole if i != q)[:20]
        want |= {(q, n + 1, i, -s if -(2**63) <= -s < 2**63 else None) for n, (s, i) in enumerate(ranked)}
    for sizes in ({}, {"block_rows": 32, "batch_queries": 2}):
        assert {tuple(r) for r in top_k(frame, **sizes).collect()} == want


def _shuffled(plan) -> int:
    """Bytes that the exchanges of a plan that has run were given."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _shuffled(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _shuffled(plan.plan())
    own = plan.metrics().apply("dataSize").value() if name == "ShuffleExchangeExec" else 0
    return own + sum(_shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_top_k_copies_no_blocks(spark):
    rng = random.Random(10)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(32)]) for i in range(1600)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    one, many = (top_k(frame, k=3, block_rows=2000, batch_queries=n) for n in (80, 2))
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in many.collect()}
    one, many = (_shuffled(x._jdf.queryExecution().executedPlan()) for x in (one, many))
    assert 1600 * 32 < one and many < 1.5 * one


def test_top_k_holds_few_wide_rows_at_once():
    schema = pa.schema([("vec_id", pa.int64()), ("q", pa.binary()), ("v", pa.list_(pa.float64()))])
    widths = [3] * 50 + [40] * 7 + [500] + [1] * 30 + [0] * 5
    rows = [{"vec_id": i, "q": bytes(4 * w), "v": None} for i, w in enumerate(widths)]
    batches = [pa.RecordBatch.from_pylist(rows[at : at + 20], schema) for at in range(0, len(rows), 20)]
    pieces = list(topk._cut(batches, topk._sizes, 25, 100))
    assert [i for p in pieces for i in p["vec_id"].to_pylist()] == list(range(len(widths)))
    assert all(p.num_rows <= 25 and (p.num_rows == 1 or p.num_rows * topk._sizes(p).max() <= 100) for p in pieces)


def test_slices_hold_large_numbers():
    rng = np.random.default_rng(3)
    values = rng.integers(-topk.LARGEST, topk.LARGEST, (200, 7))
    index = topk.Slices(np.arange(200), values)
    rows, scores = index.top(values[5], 5, 9)
    exact = values @ values[5]
    order = [i for i in sorted(range(200), key=lambda i: (-exact[i], i)) if i != 5][:9]
    assert set(rows.tolist()) == set(order) and all(exact[r] == s for r, s in zip(rows, scores, strict=True))


# --- secrets ------------------------------------------------------------------------------------


def test_scan_secrets(spark):
    rng = random.Random(2)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, truth = [], {}
    for i in range(240):
        kind = i % 4
        value = [f"token = \"{hexed(40)}\"", f"AKIA{hexed(16).upper()}", f"{rng.randrange(10**15, 10**16)}", f"http://a.example/path/{i}/article{i}name"][kind]
        rows.append((i, f"some words before {value} and some after it"))
        truth[i] = kind < 2
    rows += [(900, None), (901, ""), (902, "nothing here"), (903, "x " * 20_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("clash"))
    found = scan_secrets(frame).collect()
    assert {r.doc_id for r in found} <= set(truth)
    assert sum(r.secret == truth[r.doc_id] for r in found) >= 0.97 * len(found)
    assert {r.doc_id for r in found if truth[r.doc_id]} == {i for i in truth if truth[i]}
    labelled = spark.createDataFrame(
        [(r.doc_id, r.word_index, r.part, int(truth[r.doc_id])) for r in found if r.doc_id % 3],
        "doc_id long, word_index int, part int, label int",
    )
    held_out = [r for r in scan_secrets(frame, labelled=labelled).collect() if r.doc_id % 3 == 0]
    assert sum(r.secret == truth[r.doc_id] for r in held_out) >= 0.97 * len(held_out)
    assert scan_secrets(frame.limit(0)).count() == 0
    assert len(FEATURES) == 15


def test_scan_secrets_learns_from_rare_secrets(spark):
    rng = random.Random(4)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f"a number {rng.randrange(10**15, 10**16)} and more") for i in range(3000)]
    rows += [(i, f'here token = "{hexed(39)}f" and more') for i in range(3000, 3012)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for training_rows in (20_000, 200):  # of 200 findings by hash less than one is a secret
        found = scan_secrets(frame, training_rows=training_rows).collect()
        assert len(found) == len(rows) and all(r.secret == (r.doc_id >= 3000) for r in found)


# --- quality ----------------------------------------------------------------------------------------


SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("clash"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = labels.where("doc_id % 3 <> 0")
    scored = classify_quality(table, known)
    assert scored.count() == table.count() and scored.columns.count("score") == 1
    held = scored.join(labels.where("doc_id % 3 = 0"), "doc_id").select("accepted", "quality").collect()
    right = sum(r.accepted == (r.quality == 1) for r in held)
    assert right >= 0.97 * len(held)
    clean = [r for r in held if r.quality == 1]
    assert sum(r.accepted for r in clean) >= 0.99 * len(clean)


def test_quality_rounds_choose_new_rows(spark, monkeypatch):
    fits = []

    class Noted(quality.Logit):
        def __init__(self, x, y, weights, *more):
            if (weights != 1).any():
                fits.append({tuple(v) for v in x[weights != 1]} if x.shape[1] > 2 else set())
                sizes.append(int((weights != 1).sum()))
            super().__init__(x, y, weights, *more)

    sizes = []
    monkeypatch.setattr(quality, "Logit", Noted)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    classify_quality(table, labels, pseudo_rows=20, confident=0.6)
    last = sizes.index(max(sizes))  # a view with the pseudo-labels of all rounds
    assert sizes[last] > 40 and max(map(len, fits)) >= 0.9 * sizes[last]


def test_quality_odd_inputs(spark, docs, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert classify_quality(empty, labels).count() == 0
    for no_use in (labels.limit(0), labels.where("quality = 1"), labels.withColumn("quality", F.lit(None).cast("int"))):
        found = classify_quality(docs, no_use).collect()
        assert len(found) == docs.count() and all(r.accepted for r in found)
    bare = docs.select("doc_id", "text")
    assert classify_quality(bare, labels).where("score IS NULL").count() == 0


# --- SimHash ---------------------------------------------------------------------------------------------


def fingerprint(text):
    words = lowered(text).split()
    if not words:
        return 0
    width = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids):
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in itertools.combinations(sorted(set(prints)), 2):
        if (a ^ b).bit_count() <= 4:
            parent[root(a)] = root(b)
    least = {}
    for f, i in zip(prints, ids, strict=True):
        least[root(f)] = min(least.get(root(f), math.inf), i)
    return [least[root(f)] for f in prints]


def test_simhash_groups(docs, rows, empty):
    prints = [fingerprint(t) for _, t in rows]
    groups = components(prints, [i for i, _ in rows])
    want = {i: (f"{f:016x}", g) for (i, _), f, g in zip(rows, prints, groups, strict=True)}
    found = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint().alias("h"), "component_id")
    assert by_id(found, "h", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("part", [1024, 5])
def test_links_span_the_same_groups(spark, part):
    rng = random.Random(part)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {0, 1, 2**63, 2**64 - 1}
    for c in centres:
        prints |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(40)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in prints)
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.links_between(frame, part=part)
    root = {r.member: r.root for r in simhash.connected(links).collect()}
    found = defaultdict(set)
    for f in signed:
        found[root.get(f, f)].add(f)
    want = defaultdict(set)
    for f, g in zip(signed, components([f % (1 << 64) for f in signed], list(range(len(signed)))), strict=True):
        want[g].add(f)
    assert {frozenset(g) for g in found.values()} == {frozenset(g) for g in want.values()}


@pytest.mark.parametrize("distance", [2, 3, 4, 5])
def test_postings_meet_the_guarantee(distance):
    """Whatever bytes differ, some posting has only equal ones."""
    postings = simhash.posting_positions(distance)
    assert len(postings) == 20 or distance != 4
    for differing in itertools.combinations(range(8), distance):
        assert any(not set(p) & set(differing) for p in postings)


def test_simhash_null_and_repeated_ids(spark):
    some = [(3, "a b c d e"), (3, "a b c d e"), (None, "A b c d e"), (None, None), (8, ""), (1, "z y x w")]
    found = simhash.near_duplicates(spark.createDataFrame(some, "doc_id long, text string"))
    assert Counter((r.doc_id, r.component_id) for r in found.collect()) == Counter(
        [(3, 3), (3, 3), (None, 3), (None, 8), (8, 8), (1, 1)]
    )


def test_host_of_urls(spark):
    pages = spark.createDataFrame(
        [(1, "HTTP://u:p@A.Example.com:80/x?y#z", ""), (2, "a.example/x", ""), (3, None, "")],
        "page_id long, url string, html string",
    )
    found = {r.page_id: r.host for r in html_text.parse_pages(pages, "page_id", "url", "html").collect()}
    assert found == {1: "a.example.com", 2: "", 3: ""}
