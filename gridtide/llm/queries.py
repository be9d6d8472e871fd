"""Registered queries of the text operators: each applies its operator to its whole table."""

import public_tokenizers
from pyspark.sql import functions as F

from gridtide.llm import archive, extract, langid, lines, mixing, neardup, packing, perplexity, pii, rules, syncmers, tries, whitening

QUERIES = {}
ORACLES = {}


def query(sql=None):
    """Register a function (spark, folder) -> DataFrame under its own name."""

    def register(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages), g AS (SELECT html, max(page_id) AS holder FROM p WHERE "
    "strlen(html) >= 1000 GROUP BY 1), r AS (SELECT p.*, CASE WHEN holder <> page_id THEN holder END AS refers_to FROM p LEFT JOIN g "
    "USING (html)) SELECT page_id, url, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN refers_to IS NULL THEN "
    "'response' ELSE 'revisit' END AS record_type, refers_to, CASE WHEN refers_to IS NULL THEN sha1(html) END AS payload_verified FROM r"
)
def op1_warc_transactions(spark, folder):
    pages = table(spark, folder, "pages")
    return archive.archive_round_trip(pages)


@query()
def op2_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    return langid.predicted(docs, langid.fit_language_model(docs))


@query()
def op6_quality_rules(spark, folder):
    return rules.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op7_main_text(spark, folder):
    pages = table(spark, folder, "pages")
    return extract.main_text(pages, extract.fit_weights(pages))


@query()
def op8_personal_data(spark, folder):
    return pii.span_digest(table(spark, folder, "documents"))


@query()
def op9_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(packing.VOCABULARY))


@query(
    "WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS text FROM documents), w AS (SELECT doc_id, "
    "string_split_regex(text, '[\\x20\\x09-\\x0D]+') AS words FROM t WHERE text <> ''), s AS (SELECT DISTINCT doc_id, "
    "array_to_string(words[i:i + 4], ' ') || CASE WHEN len(words) < 5 THEN ' ' || len(words) ELSE '' END AS shingle FROM (SELECT doc_id, words, "
    "unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), "
    "c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY "
    "1, 2), e AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)), "
    "r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.doc_id = e.x) SELECT r.doc_id, "
    "coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, r.doc_id = min(root) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY 1"
)
def op10_near_duplicates(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents"))


@query()
def op4_perplexity(spark, folder):
    return perplexity.perplexities(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op3_source_mixing(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query()
def op5_syncmer_fingerprints(spark, folder):
    return syncmers.fingerprints(table(spark, folder, "documents"))


@query(
    "WITH t AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), l AS (SELECT r, "
    "doc_id, i, lines[i] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM t)), k AS (SELECT *, translate(trim(line, chr(32) || "
    "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l), h AS (SELECT "
    "key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3), d AS (SELECT k.*, "
    "coalesce(k.doc_id <> h.holder, false) AS gone FROM k LEFT JOIN h USING (key)) SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, "
    "count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY r"
)
def op11_line_dedup(spark, folder):
    kept = lines.deduplicated_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query()
def op12_embedding_whitening(spark, folder):
    return whitening.whitened(table(spark, folder, "embeddings"))


@query(
    "WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS "
    "FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT "
    "NULL), c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, "
    "length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), "
    "range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) % 4 AS h FROM o GROUP BY conv_id), r AS (SELECT c.conv_id, o.pos, "
    "o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h UNION ALL SELECT c.conv_id, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = "
    "c.base AND o.pos <= c.h), q AS (SELECT c.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS turns "
    "FROM c LEFT JOIN r USING (conv_id) GROUP BY 1), p AS (SELECT conv_id, d, turns[1:d] AS node, d = len(turns) AS ends FROM (SELECT *, "
    "unnest(range(0, len(turns) + 1)) AS d FROM q)), n AS (SELECT node, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, "
    "sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY node), k AS (SELECT "
    "node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1), m AS (SELECT n.*, coalesce(n_children, 0) AS n_children "
    "FROM n LEFT JOIN k USING (node)), s AS (SELECT node[1:d] AS node, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(CASE WHEN depth > 0 THEN "
    "(n_convs - 1) * len(regexp_extract_all(node[depth].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END)::BIGINT AS saved_tokens FROM (SELECT *, "
    "unnest(range(0, depth + 1)) AS d FROM m) GROUP BY 1) SELECT m.conv_id, m.depth, parent.conv_id AS parent_conv_id, m.n_convs, m.n_children, "
    "s.n_leaves, s.saved_tokens, m.ends_sha256 FROM m JOIN s USING (node) LEFT JOIN n parent ON m.depth > 0 AND parent.node = m.node[1:m.depth - 1]"
)
def op13_prefix_trie(spark, folder):
    return tries.prefix_trie(table(spark, folder, "conversations"))
