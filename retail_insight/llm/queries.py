"""Registered queries of the training-text operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_insight.llm import byte_bpe, conversations, simhash
from retail_insight.llm.common import table
from retail_insight.llm.exact_dedup import exact_dedup
from retail_insight.llm.html_text import extract_text
from retail_insight.llm.merkle import build_manifest, prove
from retail_insight.llm.quality import classify_quality
from retail_insight.llm.secret_scan import scan_secrets
from retail_insight.llm.source_mix import mix_sources
from retail_insight.llm.suffix_dedup import repeated_bytes
from retail_insight.llm.token_counts import count_tokens
from retail_insight.llm.token_store import write_tokens
from retail_insight.llm.topk import top_k


def op1_exact_dedup(spark, d):
    """The document that stays for every document's text."""
    return exact_dedup(table(spark, d, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op2_byte_bpe(spark, d):
    """Digests of every document's token numbers, and of what they decode to."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.digests(
        byte_bpe.encode(table(spark, d, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    )


def op3_source_mix(spark, d):
    """Words that the mix takes of every document."""
    return mix_sources(table(spark, d, "documents")).drop("source")


def op4_token_counts(spark, d):
    """Bytes and tokens of every document."""
    return count_tokens(
        table(spark, d, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
    )


def op5_html_extraction(spark, d):
    """The main text of every page."""
    return extract_text(table(spark, d, "pages"))


def op6_suffix_array_dedup(spark, d):
    """Bytes of every document that repeat 50-byte strings of an earlier one."""
    return repeated_bytes(table(spark, d, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_exact_topk(spark, d):
    """The twenty best other vectors of every twentieth vector."""
    return top_k(table(spark, d, "embeddings"))


def op8_secret_scan(spark, d):
    """Every candidate secret of all documents with its score."""
    return scan_secrets(table(spark, d, "documents"))


def op9_quality_classifier(spark, d):
    """Quality scores of all documents."""
    scored = classify_quality(table(spark, d, "documents"), table(spark, d, "labels"))
    return scored.select("doc_id", "text_score", "meta_score", "score", "accepted")


def op10_simhash_near_dedup(spark, d):
    """The fingerprint of every document, and the first document of its group."""
    return simhash.near_duplicates(table(spark, d, "documents")).select(
        "doc_id", simhash.hex_fingerprint().alias("fingerprint"), F.col("component_id")
    )


def op11_merkle_manifest(spark, d):
    """Every document's leaf and proof; some documents claim another length than is stored."""
    chosen = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    longer = F.when(chosen, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    manifest = build_manifest(table(spark, d, "documents"), fields, claimed={"n_chars": longer})
    return prove(manifest).select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2("proof", 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_token_store(spark, d):
    """Every document's numbers, written to raw files and read back by key."""
    docs = table(spark, d, "documents")
    store = write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return store.fetch(docs).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns of which a twentieth each is dropped, emptied, without stops, repeated, or the user's."""
    space = F.lit(" ")
    name = lambda c: F.coalesce(F.col(c).cast("string"), space)
    fate = F.crc32(F.encode(F.concat(name("conv_id"), F.lit(":"), name("turn")), "UTF-8")) % 20
    text = F.coalesce("text", space)
    return (
        turns.withColumn("fate", fate)
        .where("fate <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("fate") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
            F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
        )
        .drop("copy")
    )


def op13_conversation_repair(spark, d):
    """What is wrong with every damaged conversation, and the cheapest edits that repair it."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    found = conversations.summarise(conversations.repair(damaged(turns)))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = turns.select("conv_id").distinct()
    same = every["conv_id"].eqNullSafe(found["conv_id"])
    return every.join(found, same, "left").select(
        every["conv_id"],
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.sha2(F.coalesce("repaired", F.lit("")), 256).alias("repaired_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_byte_bpe,
        op3_source_mix,
        op4_token_counts,
        op5_html_extraction,
        op6_suffix_array_dedup,
        op7_exact_topk,
        op8_secret_scan,
        op9_quality_classifier,
        op10_simhash_near_dedup,
        op11_merkle_manifest,
        op12_token_store,
        op13_conversation_repair,
    )
}

ORACLE = {
    "op1_exact_dedup": """
        WITH hashed AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM hashed WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op11_merkle_manifest": """
        WITH RECURSIVE crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce(range(8),
                       lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
        marked AS (
            SELECT *, coalesce('=' || lang, '') AS tree, CAST(doc_id AS VARCHAR) AS id,
                   CAST(n_chars AS VARCHAR) AS shown,
                   xor(list_reduce(
                       list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
                       lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INT)]), CAST(4294967295 AS BIGINT)),
                       4294967295) % 7 = 0 AS chosen
            FROM documents, crc),
        told AS (
            SELECT *, CASE WHEN chosen THEN CAST(n_chars + 1 AS VARCHAR) ELSE shown END AS claimed FROM marked),
        encoded AS (
            SELECT doc_id, tree, coalesce(strlen(shown) || ':' || shown, '-') AS shown,
                   coalesce(strlen(claimed) || ':' || claimed, '-') AS claimed,
                   coalesce(strlen(text) || ':' || text, '-') AS text,
                   coalesce(strlen(id) || ':' || id, '-') || coalesce(strlen(source) || ':' || source, '-')
                       || coalesce(strlen(lang) || ':' || lang, '-') AS start
            FROM told),
        hashed AS (
            SELECT doc_id, tree, sha256(start || shown || text) AS leaf, sha256(start || claimed || text) AS claim
            FROM encoded),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                   row_number() OVER () AS r
            FROM hashed),
        nodes AS (
            SELECT tree, 0 AS level, pos, leaf AS h FROM leaves
            UNION ALL
            SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
            FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes)
            WHERE n > 1 GROUP BY tree, level, pos // 2),
        tops AS (SELECT tree, max(level) AS depth, max_by(h, level) AS subroot FROM nodes GROUP BY tree),
        trees AS (SELECT *, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM tops),
        upper AS (
            SELECT 0 AS level, place, subroot AS h FROM trees
            UNION ALL
            SELECT level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place))
            FROM (SELECT *, count(*) OVER () AS n FROM upper) WHERE n > 1 GROUP BY level, place // 2),
        whole AS (SELECT max(level) AS height, max_by(h, level) AS root FROM upper),
        inside AS (
            SELECT r, tree, unnest(range(depth)) AS step, pos FROM leaves JOIN trees USING (tree)),
        beyond AS (
            SELECT r, depth, unnest(range(height)) AS step, place FROM leaves JOIN trees USING (tree), whole),
        steps AS (
            SELECT r, step, (i.pos >> step) & 1 AS side, h
            FROM inside i LEFT JOIN nodes n ON n.tree = i.tree AND level = step AND n.pos = xor(i.pos >> step, 1)
            UNION ALL
            SELECT r, depth + step, (b.place >> step) & 1, h
            FROM beyond b LEFT JOIN upper u ON level = step AND u.place = xor(b.place >> step, 1)),
        folded AS (
            SELECT r, 0 AS step, claim AS h FROM leaves
            UNION ALL
            SELECT r, step + 1, sha256(CASE WHEN side = 1 THEN coalesce(s.h, '') || f.h ELSE f.h || coalesce(s.h, '') END)
            FROM folded f JOIN steps s USING (r, step)),
        proofs AS (
            SELECT r, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof_sha256 FROM steps GROUP BY r),
        ends AS (SELECT r, max_by(h, step) AS folded_root FROM folded GROUP BY r)
        SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
               folded_root = root AS verified
        FROM leaves JOIN trees USING (tree) JOIN ends USING (r) LEFT JOIN proofs USING (r), whole
    """,
    # By dynamic programming: of all ways to a turn and a last role, the cheapest, of those the first by letters.
    "op13_conversation_repair": r"""
        WITH RECURSIVE crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce(range(8),
                       lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
        told AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce(list_transform(string_split(
                       coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                       lambda x: CAST(ord(x) AS BIGINT)),
                       lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INT)]), CAST(4294967295 AS BIGINT)),
                       4294967295) % 20 AS fate
            FROM conversations, crc),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
                   CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM told WHERE fate <> 0),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
            FROM damaged),
        marked AS (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN again THEN 2
                           WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
            FROM placed),
        figures AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                   count(*) FILTER (fault = 3) AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
            FROM marked GROUP BY conv_id),
        added AS (
            SELECT * FROM (VALUES
                ('', '', '', CAST([] AS VARCHAR[])), ('s', 's', '', []), ('u', 'u', '', []), ('a', 'a', '', []),
                ('', 'u', 'I', ['user:']), ('s', 'u', 'I', ['user:']), ('a', 'u', 'I', ['user:']),
                ('u', 'a', 'I', ['assistant:']),
                ('', 'a', 'II', ['user:', 'assistant:']), ('s', 'a', 'II', ['user:', 'assistant:'])
            ) x(state, now, inserts, shown)),
        best AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS state,
                   {'cost': 0, 'audit': '', 'turns': CAST([] AS VARCHAR[])} AS way
            FROM figures
            UNION ALL
            SELECT conv_id, i, state, min(way)
            FROM (
                SELECT conv_id, i, CASE letter WHEN 'D' THEN now WHEN 'K' THEN left(role, 1) ELSE left(put, 1) END AS state,
                       {'cost': way.cost + 3 * len(inserts) + CASE letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
                                + CASE WHEN letter <> 'D' AND fault = 3 THEN 3 ELSE 0 END,
                        'audit': way.audit || inserts || letter,
                        'turns': way.turns || shown || CASE letter WHEN 'D' THEN CAST([] AS VARCHAR[])
                                 WHEN 'K' THEN [role || ':' || text] ELSE [put || ':' || text] END} AS way
                FROM (
                    SELECT m.conv_id, m.i, m.role, m.text, m.fault, b.way, now, inserts, shown, unnest(['D', 'K', 'R']) AS letter,
                           CASE WHEN now = 'u' THEN 'assistant' ELSE 'user' END AS put
                    FROM best b JOIN added USING (state)
                    JOIN marked m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i + 1)
                WHERE letter = 'D' OR fault IN (0, 3) AND (letter = 'R'
                      OR role <> '' AND now || left(role, 1) IN ('s', 'u', 'su', 'ua', 'au')))
            GROUP BY conv_id, i, state),
        ends AS (
            SELECT b.conv_id, min({'cost': way.cost + 3 * len(inserts), 'audit': way.audit || inserts, 'turns': way.turns || shown}) AS way
            FROM best b JOIN figures f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.n = b.i JOIN added USING (state)
            WHERE now IN ('', 'a') GROUP BY b.conv_id)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(coalesce(way.cost, 0) AS BIGINT) AS cost, coalesce(way.audit, '') AS audit,
               sha256(coalesce(array_to_string(way.turns, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
    """,
    "op7_exact_topk": """
        WITH vectors AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS (SELECT vec_id, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM vectors),
        scored AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score
            FROM parts a JOIN parts b ON a.j = b.j AND a.vec_id <> b.vec_id
            WHERE a.vec_id % 20 = 0 GROUP BY a.vec_id, b.vec_id)
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        WHERE rank <= 20
    """,
}
