"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from diamondlap.llm import (
    bpe, chat, decontamination, embedding_dedup, exact_dedup, language_id, lm_score, ngram_join, prefix_trie, secret_scan, suffix_dedup,
    url_filter, whitening,
)
from diamondlap.llm.registry import ORACLE, QUERIES, query, table
from diamondlap.sources.staging import stage

__all__ = ["ORACLE", "QUERIES"]


@query("op9_language_id")
def op9(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


@query(
    "op3_url_filter",
    """
    WITH rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                   ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    cut AS (SELECT row_number() OVER () AS k, page_id,
                   CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    urls AS (SELECT k, page_id, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
                    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM cut),
    fit AS (SELECT urls.*, h || p AS rule, v, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS n
            FROM urls LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
    SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fit WHERE n = 1
    """,
)
def op3(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.example_rules(pages))


@query("op10_chat_format")
def op10(spark, sf_dir):
    return chat.format_and_read(table(spark, sf_dir, "conversations"))


@query("op8_secret_scan")
def op8(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query("op2_byte_bpe")
def op2(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@query("op1_decontamination")
def op1(spark, sf_dir):
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_ngram_jaccard_join")
def op7(spark, sf_dir):
    return ngram_join.join_similar(table(spark, sf_dir, "documents"))


@query("op6_embedding_dedup")
def op6(spark, sf_dir):
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


@query("op4_lm_score")
def op4(spark, sf_dir):
    return lm_score.score_texts(table(spark, sf_dir, "documents"))


@query("op5_suffix_dedup")
def op5(spark, sf_dir):
    return suffix_dedup.digests(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


_NODES = """
    WITH RECURSIVE
    turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
    talks AS (SELECT conv_id AS c, list({'role': role, 'text': text} ORDER BY i) AS own FROM turns GROUP BY conv_id),
    crc AS (SELECT c, CAST(c AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS UBIGINT) AS v FROM talks
            UNION ALL
            SELECT c, s, k + 1, (CASE WHEN w % 2 = 1 THEN xor(w >> 1, CAST(3988292384 AS UBIGINT)) ELSE w >> 1 END)
            FROM (SELECT c, s, k, CASE WHEN k % 8 = 0 THEN xor(v, CAST(ascii(substr(s, k // 8 + 1, 1)) AS UBIGINT)) ELSE v END AS w FROM crc WHERE k < 8 * length(s))),
    heads AS (SELECT c, CAST(xor(v, CAST(4294967295 AS UBIGINT)) % 6 AS INT) AS h FROM crc WHERE k = 8 * length(s)),
    rebuilt AS (SELECT t.c, list_concat(coalesce(o.own[1:h], []), t.own[h + 1:]) AS path FROM talks t JOIN heads USING (c) LEFT JOIN talks o ON o.c = t.c - t.c % 100),
    steps AS (SELECT c, path, d, path[1:d] AS node FROM rebuilt, unnest(range(0, len(path) + 1)) AS u(d)),
    nodes AS (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(path) = d), '') AS ended,
                     (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(any_value(path[d]['text'])) END AS own_saved
              FROM steps GROUP BY node, d),
    kids AS (SELECT node[1:d - 1] AS parent, d - 1 AS pd, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
    full_nodes AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.parent = nodes.node AND kids.pd = nodes.d),
    below AS (SELECT n.node, n.d, u.k AS top, n.n_children, n.own_saved FROM full_nodes n, unnest(range(0, n.d + 1)) AS u(k)),
    sums AS (SELECT node[1:top] AS node, top AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own_saved) AS saved FROM below GROUP BY ALL)
    SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(f.ended) AS ends_sha256
    FROM full_nodes f JOIN sums s ON s.node = f.node AND s.d = f.d LEFT JOIN full_nodes p ON p.d = f.d - 1 AND p.node = f.node[1:f.d - 1]
"""


@query("op11_prefix_trie", _NODES)
def op11(spark, sf_dir):
    talks = prefix_trie.turns_of(table(spark, sf_dir, "conversations"))
    return prefix_trie.build_trie(prefix_trie.with_shared_heads(stage(talks, "talks")))


@query(
    "op12_exact_dedup",
    """
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
    digests AS (SELECT doc_id, sha256(body) AS text_sha256 FROM t),
    edge AS (SELECT min(doc_id) + (max(doc_id) - min(doc_id)) // 2 AS last FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, text_sha256,
           bool_or(doc_id <= last) OVER same AS member
    FROM digests, edge WINDOW same AS (PARTITION BY text_sha256)
    """,
)
def op12(spark, sf_dir):
    return exact_dedup.find_repeats(table(spark, sf_dir, "documents"))


@query("op13_whitening")
def op13(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
