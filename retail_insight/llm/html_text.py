"""Main text of web pages: by their markup, and by the runs that their host repeats."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_insight.llm.common import spread_join
from retail_insight.llm.suffix_dedup import (
    BUCKET_BYTES,
    CHUNK_BYTES,
    MIX,
    NAMES_PER_RANGE,
    _ranges,
    _released,
    _squeezed,
)
from retail_insight.sources.workspace import stage, stage_by

TOKENS = 8  # of a run that counts as long
PLACE_BITS = 14  # of a page's key: its place in a chunk
# An article's block goes only if this share of its host's contents, and so many, hold all of it.
NAMED_SHARE = 0.75
NAMED_CONTENTS = 10

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<raw>script|style|textarea|title|noscript|template|iframe)\b(?:"[^"]*"|'[^']*'|[^'">])*+>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][-\w:]*)(?P<attributes>(?:"[^"]*"|'[^']*'|[^'">])*+)>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")
# Elements of HTML and words that name a part of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
LEFT_OUT = frozenset(
    "head nav footer aside form menu button select option label svg canvas object audio video dialog".split()
)
NAMES_LEFT_OUT = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary "
    "contentinfo cookie cookies consent disqus footer menu modal nav navbar navigation newsletter notice "
    "popup promo promotion related reply replies respond share sharing sidebar social sponsor sponsored "
    "subscribe toolbar widget".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OF_HEAD = frozenset("base basefont bgsound head html link meta noframes".split())  # beside the raw ones
# Parts that have articles of their own, which are never the page's.
NEVER_HOLD = frozenset("nav footer aside".split())
NAMES_NEVER_HOLD = frozenset("comment comments disqus related replies reply respond".split())


def _names(attributes: str) -> tuple[list[str], bool]:
    """The whole names in class, id and role, and whether the role is the main part."""
    names, main = [], False
    for key, value in _ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        key = key.lower()
        if key in ("class", "id", "role"):
            found = html.unescape(value.strip("\"'")).lower().split()
            main |= key == "role" and "main" in found
            names += found
    return names, main


def _any_of(names: list[str], words: frozenset[str]) -> bool:
    """Whether a name is one of the words, or made of nothing else: cookie-notice, but not related-work."""
    return any(words.issuperset(_WORD.findall(n)) and _WORD.search(n) for n in names)


def _left_out(name: str, names: list[str], in_article: bool) -> bool:
    if name in LEFT_OUT or name == "header" and not in_article:
        return True
    if name in ("html", "body", "main") or in_article and name in HEADINGS:
        return False
    return _any_of(names, NAMES_LEFT_OUT)


def _read(page: str, kept: frozenset[int]) -> tuple[list[tuple[str, bool]], bool, set[int], set[int]]:
    """Text blocks, each with whether it is inside an article, and whether one was found.

    Also the numbers of the elements that were left out although they hold a
    main part, or an article. Elements whose number is in ``kept`` stay.
    """
    found: list[tuple[str, bool]] = []
    held: list[str] = []
    open_tags: list[tuple[str, bool, bool, int, bool]] = []  # name, left out, in article, number, may hold one
    hold_main: set[int] = set()
    hold_article: set[int] = set()
    named = False

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            found.append((text, inside))

    out = inside = False
    at = 0
    for number, tag in enumerate(_TAG.finditer(page)):
        if open_tags and open_tags[-1][0] == "head" and page[at : tag.start()].strip():
            open_tags.pop()  # text ends the head
            out = bool(open_tags) and open_tags[-1][1]
        if not out and at < tag.start():
            held.append(page[at : tag.start()])
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        if open_tags and open_tags[-1][0] == "head" and not tag["close"] and name not in OF_HEAD:
            open_tags.pop()  # so does any element of the body
            out = bool(open_tags) and open_tags[-1][1]
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCK:
            flush()
        if tag["close"]:
            for depth in range(len(open_tags) - 1, -1, -1):
                if open_tags[depth][0] == name:
                    del open_tags[depth:]
                    break
        elif name not in VOID and not tag["attributes"].endswith("/"):
            if name in BLOCK:  # a paragraph ends where another block starts
                for depth in range(len(open_tags) - 1, -1, -1):
                    if open_tags[depth][0] == "p":
                        del open_tags[depth:]
                        break
                    if open_tags[depth][0] in BLOCK:
                        break
            _, out, inside, _, holds = open_tags[-1] if open_tags else ("", False, False, 0, True)
            names, is_main = _names(tag["attributes"])
            is_main |= name == "main"
            main = is_main or name == "article"
            drop = out or number not in kept and _left_out(name, names, inside)
            holds = holds and name not in NEVER_HOLD and not _any_of(names, NAMES_NEVER_HOLD)
            named |= main and not drop
            open_tags.append((name, drop, inside or main, number, holds))
            if drop and is_main:
                hold_main.update(t[3] for t in open_tags)
            elif drop and main and holds:
                hold_article.update(t[3] for t in open_tags)
        out = bool(open_tags) and open_tags[-1][1]
        inside = bool(open_tags) and open_tags[-1][2]
    if open_tags and open_tags[-1][0] == "head" and page[at:].strip():
        open_tags.pop()
        out = bool(open_tags) and open_tags[-1][1]
    if not out:
        held.append(page[at:])
    flush()
    return found, named, hold_main, hold_article


def blocks_of(page: str | None) -> tuple[list[str], bool]:
    """The text blocks that the markup allows, and whether it names the article.

    With an ``article`` or ``main`` element only its blocks count, and all of
    them do. Without one, every block outside menus, headers, footers and the
    like is returned, for the host's repeats to decide.

    An element that would be left out stays if it holds the main part, or the
    only articles (not those of comments, related pages, menus, footers and
    asides). Such articles are the page if they have at least half of its
    text; if not, all blocks are returned.
    """
    page = page or ""
    found, named, hold_main, hold_article = _read(page, frozenset())
    if hold_main:
        found, named, _, hold_article = _read(page, frozenset(hold_main))
    if not named and hold_article:
        found, _, _, _ = _read(page, frozenset(hold_article))
        within = sum(len(text) for text, inside in found if inside)
        named = 0 < within >= sum(len(text) for text, inside in found if not inside)
    return [text for text, within in found if within or not named], named


def parse_pages(pages: DataFrame, page_id: str, url: str, page: str) -> DataFrame:
    """``page_id``, ``url``, ``host``, ``blocks`` and ``named`` for every page."""
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [blocks_of(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([b for b, _ in parsed], pa.list_(pa.string())),
                    pa.array([n for _, n in parsed], pa.bool_()),
                ],
                names=["page_id", "url", "blocks", "named"],
            )

    slim = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("page")
    )
    parsed = slim.mapInArrow(run, f"page_id {kind}, url string, blocks array<string>, named boolean")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][-+.a-zA-Z0-9]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return parsed.withColumn("host", host)


OF_PAGES = ("page_ids", "urls", "hosts", "named", "contents", "blocks")


def _chunks(parsed: DataFrame) -> DataFrame:
    """Parsed pages in rows of about CHUNK_BYTES of text, where they lie: arrays with a place for each page."""
    kind = parsed.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            blocks = batch.column(batch.schema.get_field_index("blocks"))
            text = blocks.flatten()
            offsets = np.asarray(blocks.offsets) - blocks.offsets[0].as_py()
            before = np.concatenate(([0], np.cumsum(np.asarray(pc.binary_length(text)) + 16)))[offsets]
            words = np.concatenate(([0], np.cumsum(np.asarray(pc.count_substring(text, " ")) + 2)))[offsets]
            start = 0
            while start < batch.num_rows:
                end = int(np.searchsorted(before, before[start] + CHUNK_BYTES))
                end = min(max(end, start + 1), start + (1 << PLACE_BITS), batch.num_rows)
                row = {
                    name: pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), column[start:end])
                    for name, column in zip(OF_PAGES, batch.columns, strict=True)
                }
                row["chunk"] = pa.array([(task << 24) + done], pa.int64())
                row["n_tokens"] = pa.array([int(words[end] - words[start])], pa.int64())
                yield pa.RecordBatch.from_pydict(row)
                start, done = end, done + 1

    return parsed.select("page_id", "url", "host", "named", "content", "blocks").mapInArrow(
        run,
        f"page_ids array<{kind}>, urls array<string>, hosts array<string>, named array<boolean>, "
        "contents array<binary>, blocks array<array<string>>, chunk long, n_tokens long",
    )


def _stream(blocks: list[str]) -> list[str]:
    """The tokens of a page, a mark behind each block."""
    return [token for block in blocks for token in (*block.split(" "), "\n")]


class _Suffixes:
    """The suffixes of the contents of a chunk, named by their host and first ``size`` tokens."""

    def __init__(self, row: dict, size: int, bits: int):
        self.row, self.size, self.bits = row, size, bits
        copies = set(row["copies"] or ())
        self.places = [p for p, blocks in enumerate(row["blocks"]) if blocks and p not in copies]
        streams = [_stream(row["blocks"][p]) for p in self.places]
        self.tokens = [token for stream in streams for token in stream]
        lengths = np.array([len(stream) for stream in streams], np.int64)
        fits = np.maximum(lengths - size + 1, 0)
        self.doc = np.repeat(np.arange(len(streams)), fits)
        self.at = np.arange(len(self.doc)) - (np.cumsum(fits) - fits)[self.doc]
        self.start = (np.cumsum(lengths) - lengths)[self.doc] + self.at
        coded = pa.array(self.tokens, pa.string()).dictionary_encode()
        words = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
        words = words[np.asarray(coded.indices)]
        hosts = np.array([xxhash.xxh3_64_intdigest(row["hosts"][p]) for p in self.places], np.uint64)
        name = hosts[self.doc]
        for offset in range(size):
            name ^= words[self.start + offset]
            name *= MIX[0]
            name ^= name >> np.uint64(32)
        name = (name * MIX[1] ^ name >> np.uint64(29)) >> np.uint64(64 - bits)
        self.order = np.argsort(name, kind="stable")
        name, doc = name[self.order], self.doc[self.order]
        fresh = np.diff(name, prepend=~name[:1]) != 0
        self.names = name[fresh]
        self.group = np.cumsum(fresh) - 1
        content = fresh | (np.diff(doc, prepend=-1) != 0)
        self.held = np.bincount(self.group[content], minlength=len(self.names)).astype("<u4")
        self.named = np.array([row["named"][p] for p in self.places], bool)
        self.open = np.zeros(len(self.names), np.uint8)  # whether a content that names no article has it
        self.open[self.group[~self.named[doc]]] = 1

    def repeated(self, ranges: int) -> Iterator[pa.RecordBatch]:
        """Those whose name enough contents have, here and in all chunks: for this one, or for an open one."""
        answers = {x["range"]: x for x in self.row["found"] or ()}
        held, is_open = np.zeros(len(self.names), np.int64), np.zeros(len(self.names), bool)
        for r, part in _ranges(self.names, self.bits, ranges):
            held[part] = _released(answers[r]["held"], "<u4")
            is_open[part] = _released(answers[r]["open"], "u1")
        of_host = {x["host"]: x["contents"] for x in self.row["of_host"] or ()}
        of_host = np.array([of_host[self.row["hosts"][p]] for p in self.places], np.int64)
        need = np.where(self.named, np.maximum(NAMED_CONTENTS, NAMED_SHARE * of_host), 2)
        need = np.where(is_open[self.group], 2, need[self.doc[self.order]])
        which = self.order[held[self.group] >= need]
        places = np.array(self.places, np.int64)
        for part in np.array_split(which, len(which) // 50_000 + 1):
            place = places[self.doc[part]]
            prefix = [" ".join(self.tokens[i : i + self.size]) for i in self.start[part].tolist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.array((self.row["chunk"] << PLACE_BITS) + place, pa.int64()),
                    "host": pa.array([self.row["hosts"][p] for p in place.tolist()], pa.string()),
                    "named": pa.array([self.row["named"][p] for p in place.tolist()], pa.bool_()),
                    "at": pa.array(self.at[part], pa.int32()),
                    "prefix": pa.array(prefix, pa.string()),
                }
            )


def _counted(names: DataFrame) -> DataFrame:
    """Each range's names sorted in one group: how many contents have each, and if an open one has; by chunk."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [np.cumsum(_released(row["names"], "<u8")) for row in rows]
        _, group = np.unique(np.concatenate(parts), return_inverse=True)
        ends = np.cumsum([len(part) for part in parts])[:-1]

        def sums(column: str, kind: str) -> np.ndarray:
            return np.bincount(group, np.concatenate([_released(row[column], kind) for row in rows]))[group]

        held, is_open = sums("held", "<u4").astype("<u4"), (sums("open", "u1") > 0).astype("u1")
        return pa.table(
            {
                "chunk": pa.array([row["chunk"] for row in rows], pa.int64()),
                "range": pa.array([row["range"] for row in rows], pa.int32()),
                "held": pa.array([_squeezed(x) for x in np.split(held, ends)], pa.binary()),
                "open": pa.array([_squeezed(x) for x in np.split(is_open, ends)], pa.binary()),
            }
        )

    counted = names.groupBy("range").applyInArrow(run, "chunk long, range int, held binary, open binary")
    return counted.groupBy("chunk").agg(F.collect_list(F.struct("range", "held", "open")).alias("found"))


def _repeated_suffixes(texts: DataFrame, tokens: int) -> DataFrame:
    """``key``, ``host``, ``named``, ``at`` and ``prefix`` of the suffixes that enough others may equal.

    The distinct names of a chunk are sorted by range together with those of
    all chunks, and the number of contents with each goes back. Equal suffixes
    have equal names; few others do, and their tokens tell those apart later.
    """
    total = texts.agg(F.sum("n_tokens")).first()[0] or 0
    bits = min(64, max(32, total.bit_length() + 8))
    ranges = total // NAMES_PER_RANGE + 1

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            suffixes = _Suffixes(row, tokens, bits)
            for r, part in _ranges(suffixes.names, bits, ranges):
                yield pa.RecordBatch.from_pydict(
                    {
                        "range": pa.array([r], pa.int32()),
                        "chunk": pa.array([row["chunk"]], pa.int64()),
                        "names": pa.array([_squeezed(np.diff(suffixes.names[part], prepend=np.uint64(0)))], pa.binary()),
                        "held": pa.array([_squeezed(suffixes.held[part])], pa.binary()),
                        "open": pa.array([_squeezed(suffixes.open[part])], pa.binary()),
                    }
                )

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield from _Suffixes(row, tokens, bits).repeated(ranges)

    texts = texts.select("chunk", "hosts", "named", "blocks", "copies", "of_host")
    sent = texts.mapInArrow(names, "range int, chunk long, names binary, held binary, open binary")
    answers = stage(_counted(sent), "suffix-answers")
    return texts.join(answers, "chunk", "left").mapInArrow(
        repeated, "key long, host string, named boolean, at int, prefix string"
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _repeated_runs(texts: DataFrame, hosts: DataFrame, tokens: int) -> DataFrame:
    """``key``, ``named`` and ``starts``: where in a content's tokens the runs start that its host repeats.

    ``texts`` has the chunks with the places of copies and the number of
    contents of each host in them, ``hosts`` that number for all hosts. Equal suffixes are grouped by their first ``tokens``
    tokens. In a content that does not name its article two contents are
    enough; in one that does, NAMED_SHARE of the host's contents must hold the
    run, and NAMED_CONTENTS at least.
    """
    suffixes = stage(_repeated_suffixes(texts, tokens), "suffixes")
    ranks = suffixes.groupBy("host", "prefix").agg(F.count_distinct("key").alias("held")).where("held > 1")
    equal = spread_join(suffixes, ranks, ["host", "prefix"], by="key").drop("prefix")
    open_runs = equal.where("NOT named").select("key", "named", "at")
    common = equal.where(F.col("named") & (F.col("held") >= NAMED_CONTENTS))
    common = spread_join(common, hosts, ["host"], by="key").where(F.col("held") >= NAMED_SHARE * F.col("contents"))
    runs = open_runs.unionByName(common.select("key", "named", "at"))
    return runs.groupBy("key", "named").agg(F.collect_set("at").alias("starts"))


def _without_runs(blocks: list[str], starts: list[int], named: bool, tokens: int) -> list[str]:
    """The blocks without repeated runs; a named article loses a block only if all of it is repeated."""
    gone = np.zeros(sum(block.count(" ") + 2 for block in blocks), bool)
    for start in starts:
        gone[start : start + tokens] = True
    kept, at = [], 0
    for block in blocks:
        words = block.split(" ")
        mask = gone[at : at + len(words)]
        at += len(words) + 1
        if named:
            kept += [] if mask.all() else [block]
        elif not mask.all():
            kept.append(" ".join(w for w, out in zip(words, mask.tolist(), strict=True) if not out))
    return kept


def _cut(tokens: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                page_ids, urls, blocks, runs = (column.flatten() for column in batch.slice(i, 1).columns)
                kept = blocks.to_pylist()
                for page in runs.to_pylist():
                    p = page["place"]
                    kept[p] = _without_runs(kept[p], page["starts"], page["named"], tokens)
                text = pa.array(["\n".join(of_page) for of_page in kept], pa.string())
                yield pa.RecordBatch.from_arrays([page_ids, urls, text], names=["page_id", "url", "text"])

    return run


def extract_text(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", tokens: int = TOKENS
) -> DataFrame:
    """``page_id``, ``url`` and the main ``text`` of every page, with ``n_chars``.

    Markup, scripts, styles, menus, headers, footers, sidebars, notices,
    adverts, forms and comments go by element and by class, id or role. The
    token streams of what remains of all pages of a host are then put in
    suffix order, and runs of ``tokens`` or more tokens that occur in other
    contents of the host are boilerplate; the unique runs stay. On a page that
    names its article this is checked: articles quote and copy each other, so
    only whole blocks go there, and only those whose runs NAMED_SHARE of the
    host's contents (NAMED_CONTENTS at least) hold: notices without a name.
    Pages of a host with equal blocks are one content (named if one of them is):
    copies and repeated rows do not count against each other, and each gets
    the content's result.

    Character references are decoded, white space inside a block becomes one
    space, blocks are trimmed and joined by a line feed in page order. Null
    pages count as empty and give an empty text; a null URL has the empty
    host; rows that repeat an id each come out; no rows give no rows.

    Texts are staged once, in chunks bucketed by chunk, and never shuffled;
    names of suffixes, and the suffixes that repeat, are.
    """
    total = pages.agg(F.sum(F.octet_length(F.col(page).cast("string")))).first()[0] or 0
    parsed = parse_pages(pages, page_id, url, page).withColumn(
        "content",
        F.when(F.size("blocks") > 0, F.unhex(F.sha2(F.array_join("blocks", "\n"), 256))),
    )
    chunks = stage_by(_chunks(parsed), "chunk", total // BUCKET_BYTES + 1, "parsed_pages")
    place = F.posexplode(F.arrays_zip("hosts", "contents", "named")).alias("place", "page")
    every = chunks.select("chunk", place).where("page.contents IS NOT NULL")
    key = (F.shiftleft("chunk", PLACE_BITS) + F.col("place")).alias("key")
    every = every.select(
        key, F.col("page.hosts").alias("host"), F.col("page.contents").alias("content"), (~F.col("page.named")).alias("open")
    )
    contents = every.groupBy("host", "content").agg(F.min(F.struct("open", "key"))["key"].alias("first"), F.count("*").alias("n"))
    contents = stage(contents, "contents")
    late = spread_join(every, contents.where("n > 1").drop("n"), ["host", "content"], by="key").where("key <> first")
    late = stage(late.select("key", "first"), "copies")
    chunk, at = F.shiftright("key", PLACE_BITS).alias("chunk"), F.col("key").bitwiseAND((1 << PLACE_BITS) - 1).cast("int")
    copies = late.groupBy(chunk).agg(F.collect_list(at).alias("copies"))
    hosts = stage(contents.groupBy("host").agg(F.count("*").alias("contents")), "hosts")
    met = every.select(F.shiftright("key", PLACE_BITS).alias("chunk"), "host").distinct()
    met = spread_join(met, hosts, ["host"], by="chunk").groupBy("chunk")
    of_host = met.agg(F.collect_list(F.struct("host", "contents")).alias("of_host"))
    texts = chunks.join(copies, "chunk", "left").join(of_host, "chunk", "left")
    runs = stage(_repeated_runs(texts, hosts, tokens), "runs")
    of_copies = spread_join(late, runs.withColumnRenamed("key", "first"), ["first"], by="key").drop("first")
    gone = runs.unionByName(of_copies).groupBy(chunk).agg(
        F.collect_list(F.struct(at.alias("place"), "named", "starts")).alias("runs")
    )
    kind = pages.schema[page_id].dataType.simpleString()
    return (
        chunks.select("chunk", "page_ids", "urls", "blocks")
        .join(gone, "chunk", "left")
        .select("page_ids", "urls", "blocks", "runs")
        .mapInArrow(_cut(tokens), f"page_id {kind}, url string, text string")
        .withColumn("n_chars", F.char_length("text").cast("long"))
    )
