"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from storegrain.llm import (
    decontaminate, minhash, pieces, pii, quality, repair, secret_scan, sharding, suffix_dedup, token_files, trie, urls, winnowing,
)
from storegrain.llm.common import table
from storegrain.session import staging_path

QUERIES: dict = {}
SQL: dict[str, str] = {}
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function
    return add


@query("op2_minhash_near_dedup", rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) >= 3
      THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS MATERIALIZED (SELECT x.doc_id AS u, y.doc_id AS v FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id
    GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
l AS MATERIALIZED (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.v FROM r JOIN l ON l.u = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.a = s.doc_id""")
def op2_minhash_near_dedup(spark, folder):
    return minhash.near_duplicates(table(spark, folder, "documents"), k=3, percent=85)


@query("op1_suffix_array_dedup")
def op1_suffix_array_dedup(spark, folder):
    return suffix_dedup.repeated_passages(table(spark, folder, "documents")).drop("spans")


WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op6_benchmark_decontamination", rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS ws FROM benchmark),
w AS (SELECT item, least(len(ws), 13) AS size, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i, ws FROM b WHERE len(ws) > 0),
p AS MATERIALIZED (SELECT DISTINCT item, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase FROM w),
sizes AS (SELECT DISTINCT size FROM p),
g AS (SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS i, ws FROM d, sizes WHERE len(ws) >= size),
h AS MATERIALIZED (SELECT g.doc_id, g.i, g.size, p.item FROM g JOIN p ON g.size = p.size
    AND array_to_string(g.ws[g.i:g.i + g.size - 1], ' ') = p.phrase),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS place FROM h) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op6_benchmark_decontamination(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.digests(decontaminate.find_benchmark(docs, table(spark, folder, "benchmark")))


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}'))"


@query("op7_url_filters", rf"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*', 0, 's') ELSE '' END AS rest
    FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/]*', 0, 's'), '{UPPER}', '{SMALL}') AS host, coalesce(rest, '') AS rest FROM r),
p AS (SELECT page_id, host, substr(rest, length(host) + 1) AS path FROM h),
c AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') AS canonical FROM p),
l AS (SELECT DISTINCT canonical FROM c WHERE starts_with(host, 'spam')),
j AS (SELECT page_id, host, path, CASE WHEN {_fits('example.net', '/en/')} THEN 'example.net/en/' WHEN {_fits('example.com', '/de/')}
      THEN 'example.com/de/' WHEN {_fits('org', '/fr/')} THEN 'org/fr/' WHEN {_fits('net', '/')} THEN 'net/' END AS rule,
      canonical IN (SELECT canonical FROM l) AS listed FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM j""")
def op7_url_filters(spark, folder):
    """The list: URLs of hosts that name themselves spam."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    listed = pages.where(urls.host_and_path(F.col("url"))[0].startswith("spam")).select("url")
    return urls.judge_urls(pages, urls.rules_table(spark), listed)


@query("op9_secret_scans")
def op9_secret_scans(spark, folder):
    return secret_scan.digests(secret_scan.find_secrets(table(spark, folder, "documents").select("doc_id", "text")))


@query("op10_sharding")
def op10_sharding(spark, folder):
    return sharding.shard_documents(table(spark, folder, "documents"))


@query("op5_document_fingerprints")
def op5_document_fingerprints(spark, folder):
    return winnowing.fingerprint_pairs(table(spark, folder, "documents"))


@query("op3_sentencepiece")
def op3_sentencepiece(spark, folder):
    """Ids and scores of every text, and whether decoding gives the text back."""
    model = pieces.default_model()
    return pieces.encode_texts(table(spark, folder, "documents").select("doc_id", "text"), model, round_trip=True,
                               kept_bytes=3 * pieces.KEPT_BYTES).drop("text")


@query("op4_quality_classifier")
def op4_quality_classifier(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, quality.graded(table(spark, folder, "labels")))
    return quality.judge(docs, model).drop("text")


@query("op8_token_counts")
def op8_token_counts(spark, folder):
    path = staging_path(spark, "token-files")
    token_files.write_tokens(table(spark, folder, "documents"), path, *token_files.default_tokenizer())
    return token_files.count_tokens(spark, path)


@query("op12_pii")
def op12_pii(spark, folder):
    return pii.digests(pii.find_personal_data(table(spark, folder, "documents").select("doc_id", "text")))


@query("op11_conversation_repair")
def op11_conversation_repair(spark, folder):
    conversations = table(spark, folder, "conversations")
    return repair.digests(repair.repair(repair.damaged(conversations)), conversations.select("conv_id"))


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    step = "list_reduce(list_concat([xor(c, b)], range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)"
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), "
            f"lambda c, b: {step}), 4294967295)")


@query("op13_conversation_trie", rf"""
WITH t AS (SELECT conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations),
own AS (SELECT conv_id, list(turn ORDER BY pos) AS turns FROM t GROUP BY 1),
ids AS (SELECT conv_id, turns, conv_id - conv_id % 5 AS source, {_crc32('conv_id::VARCHAR')} % 9 AS h FROM own WHERE conv_id IS NOT NULL),
s AS MATERIALIZED (SELECT ids.conv_id, list_concat(coalesce(o.turns[1:ids.h], []), ids.turns[ids.h + 1:]) AS seq FROM ids LEFT JOIN own o ON o.conv_id = ids.source),
p AS MATERIALIZED (SELECT conv_id, seq[1:d] AS path, d, d = len(seq) AS ends FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM s)),
n AS MATERIALIZED (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends) AS ids FROM p GROUP BY 1, 2),
k AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * octet_length(encode(path[d].t)) ELSE 0 END AS saved FROM n LEFT JOIN k USING (path)),
u AS (SELECT path[1:a] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
      FROM (SELECT *, unnest(range(d + 1)) AS a FROM f) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(coalesce(f.ids, '')) AS ends_sha256
FROM f JOIN u USING (path) LEFT JOIN f q ON f.d > 0 AND q.path = f.path[1:f.d - 1]""")
def op13_conversation_trie(spark, folder):
    return trie.trie_nodes(*trie.rebuilt(trie.turn_keys(table(spark, folder, "conversations"))))
