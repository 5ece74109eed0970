"""The registered queries of the text operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprint, html, langid, packing, quality, repair, trie, urls, warc
from .jaccard import jaccard_classes
from .substring import remove_duplicate_spans


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces, packed into sequences of at most 1024 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    vocabulary, added = bpe.Vocabulary.of_json(path)
    pieces = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary, added, path, most=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and what they decode to, as digests."""
    vocabulary = bpe.Vocabulary.of_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary).select("doc_id", "ids", "offsets")
    return bpe.digests(bpe.decode(encoded, vocabulary))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered text of every conversation that is no snapshot of a longer one."""
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP3_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos, role, text
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
keys AS (
  SELECT *, string_agg(md5(coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1))), '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix,
         max(pos) OVER (PARTITION BY conv_id) AS turns
  FROM t),
inner_prefixes AS (SELECT DISTINCT prefix FROM keys WHERE pos < turns),
kept AS (
  SELECT min(conv_id) AS conv_id, count(*) AS copies
  FROM keys WHERE pos = turns AND prefix NOT IN (SELECT prefix FROM inner_prefixes) GROUP BY prefix)
SELECT conv_id, max(turns)::BIGINT AS n_turns, max(copies)::BIGINT AS copies,
       string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS chat
FROM keys JOIN kept USING (conv_id) GROUP BY conv_id
"""


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents that links of at least 0.8 between 5-word shingle sets connect."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_classes(docs, words=5, percent=80).select("doc_id", "n_shingles", "component_id")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fingerprint.edited_with_next(docs)
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "contained_next")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of every document, and whether the votes of the rules keep it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = quality.judge(docs)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


#: (verdict, host, path) of the rules that op7 judges by.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH rules(verdict, rule_host, rule_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
parts AS (
  SELECT row_number() OVER () AS r, page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
best AS (
  SELECT r, max_by({'rule': rule_host || rule_path, 'verdict': verdict}, length(rule_host || rule_path)) AS b
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY r)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (r)
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that no repeated 13-word window covers, of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = remove_duplicate_spans(docs, window=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs, most_docs=4000)
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, i AS start, array_to_string(words[i:i + 12], ' ') AS body
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
earliest AS (SELECT body, min(doc_id) AS least FROM windows GROUP BY body),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + 13)) AS j
  FROM windows JOIN earliest USING (body) WHERE least < doc_id),
each AS (SELECT doc_id, words[j] AS word, j FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS j FROM w)),
kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.j) AS body, count(*) AS n
  FROM each e ANTI JOIN covered c ON e.doc_id = c.doc_id AND e.j = c.j GROUP BY e.doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.body, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the rebuilt conversations as a node of their trie."""
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _crc_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, a bit at a time."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda l: ord(l)::BIGINT)), lambda c, b: {step}))"


OP11_SQL = f"""
WITH plain AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT *, md5(length(role) || ':' || role || text) AS id FROM plain),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS p FROM turns),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc_sql("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
mixed AS (
  SELECT c.conv_id, 0 AS part, p, id, text FROM c JOIN t ON t.conv_id = c.base AND p <= h
  UNION ALL SELECT c.conv_id, 1, p, id, text FROM c JOIN t ON t.conv_id = c.conv_id AND p > h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS d, id, length(text) AS chars FROM mixed),
paths AS (
  SELECT conv_id, d, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY d) AS path, chars FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM paths GROUP BY path, d),
sizes AS (SELECT conv_id, max(d) AS d FROM paths GROUP BY conv_id),
ends AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM paths JOIN sizes USING (conv_id, d) GROUP BY path),
kids AS (SELECT left(path, 32 * (d - 1)) AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
below AS (SELECT left(path, 32 * i) AS path, (n_convs - 1) * chars AS saved, path NOT IN (SELECT path FROM kids) AS leaf FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM nodes)),
sums AS (SELECT path, sum(saved) AS saved, count_if(leaf) AS leaves FROM below GROUP BY path)
SELECT nodes.conv_id, nodes.d::BIGINT AS depth, up.conv_id AS parent_conv_id, nodes.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
       sums.leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens, coalesce(ends.sha, sha256('')) AS ends_sha256
FROM nodes JOIN sums USING (path) LEFT JOIN kids USING (path) LEFT JOIN ends USING (path)
LEFT JOIN nodes up ON nodes.d > 0 AND up.path = left(nodes.path, 32 * (nodes.d - 1))
"""

def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, its cheapest edits, and a digest of what they leave."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair.audit_conversations(repair.damaged(talks), talks)


OP12_SQL = f"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
  FROM source WHERE f <> 0),
numbered AS (
  SELECT *, left(role, 1) AS initial, md5(length(role) || ':' || role || text) AS digest,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS occurrence
  FROM damaged),
rows_ AS (
  SELECT *, lead(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS following,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN occurrence > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault
  FROM numbered),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
         count_if(fault = 'truncated') AS truncated, count_if(following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id),
inserted(q, label, r, cost) AS (VALUES (0, '', 0, 0), (1, '', 1, 0), (2, '', 2, 0), (3, '', 3, 0), (0, 'I', 2, 5), (1, 'I', 2, 5), (2, 'I', 3, 5), (3, 'I', 2, 5), (0, 'II', 3, 10), (1, 'II', 3, 10)),
arcs(q, label, initial, r, cost) AS (
  VALUES (0, 'D', '', 0, 2), (1, 'D', '', 1, 2), (2, 'D', '', 2, 2), (3, 'D', '', 3, 2), (0, 'R', '', 2, 1), (1, 'R', '', 2, 1), (2, 'R', '', 3, 1), (3, 'R', '', 2, 1),
         (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0)),
paths AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS q, 0 AS cost, '' AS audit FROM counts
  UNION ALL
  SELECT conv_id, pos, q, cost, audit
  FROM (
    SELECT p.conv_id, t.pos, a.r AS q, p.cost + i.cost + a.cost + CASE WHEN a.label <> 'D' AND t.fault = 'truncated' THEN 5 ELSE 0 END AS cost, p.audit || i.label || a.label AS audit
    FROM paths p JOIN inserted i ON i.q = p.q JOIN arcs a ON a.q = i.r JOIN rows_ t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.pos = p.pos + 1
    WHERE a.label = 'D' OR (t.fault NOT IN ('blank', 'duplicate') AND (a.label = 'R' OR a.initial = t.initial)))
  QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
ended AS (
  SELECT c.conv_id, p.cost + i.cost AS cost, p.audit || i.label AS audit
  FROM counts c JOIN paths p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.pos = c.n JOIN inserted i ON i.q = p.q AND i.r IN (0, 3)),
best AS (SELECT conv_id, cost, audit FROM ended QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
labels AS (SELECT conv_id, j, substr(audit, j, 1) AS label FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM best)),
edits AS (SELECT *, count_if(label <> 'I') OVER w AS pos, count_if(label <> 'D') OVER w AS o FROM labels WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
lines AS (SELECT e.conv_id, j, label, o, role, initial, CASE WHEN label = 'I' THEN '' ELSE text END AS text FROM edits e JOIN rows_ t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.pos = greatest(e.pos, 1) WHERE label <> 'D'),
started AS (SELECT *, max(CASE WHEN o = 1 AND label = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s FROM lines),
fixed AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN label = 'K' THEN role WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS sha FROM started GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN fixed f ON f.conv_id IS NOT DISTINCT FROM e.conv_id
"""

def op13_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages say of each record when they are read back."""
    out = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), least_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, strlen(html) AS payload_bytes, list_transform(range(8), lambda i: ('0x' || substr(sha1(html), 5 * i + 1, 5))::BIGINT) AS fives,
         first_value(r) OVER w AS first_r, first_value(page_id) OVER w AS first_id, r
  FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST, r DESC))
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(fives, lambda n: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> k::INTEGER) & 31)::INTEGER + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN r = first_r THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r <> first_r THEN first_id END AS refers_to
FROM d
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_chat_format": op3_chat_format,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_fingerprint": op5_fingerprint,
    "op6_quality_rules": op6_quality_rules,
    "op7_url_filter": op7_url_filter,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_language_id": op10_language_id,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_structure_repair": op12_structure_repair,
    "op13_warc_archives": op13_warc_archives,
}

ORACLES: dict[str, str] = {
    "op3_chat_format": OP3_SQL,
    "op7_url_filter": OP7_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_structure_repair": OP12_SQL,
    "op13_warc_archives": OP13_SQL,
}
