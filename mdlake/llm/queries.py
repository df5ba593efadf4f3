"""The queries of this package for ``__spark_entry__``: ``opN_<name>`` applies
operator N to its whole table; ``ORACLE_SQL`` has DuckDB SQL for the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdlake.llm import bpe, chat, decontam, langid, neardup, pieces, quality, sharding, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no times: a page is captured ``page_id`` seconds after a fixed moment."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    captured = F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0)))
    out = warc.archive_and_index(pages, captured)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "capture_order")


def op2_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 are the chosen and the rejected of a pair."""
    turns = chat.turns(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    pairs = chat.pair_up(turns, F.floor(F.col("conv_id") / 2).cast("long"), F.col("conv_id") % 2 == 0)
    trained = lambda c: F.aggregate(c, F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")
    return chat.preference_rows(pairs).select(
        "pair_id",
        "n_prompt_turns",
        F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_sha256"),
        F.sha2(F.col("chosen_text").cast("binary"), 256).alias("chosen_sha256"),
        F.sha2(F.col("rejected_text").cast("binary"), 256).alias("rejected_sha256"),
        trained("chosen_spans").alias("chosen_trained"),
        trained("rejected_spans").alias("rejected_trained"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text model is fitted on labelled documents, the evidence is of pages."""
    model = langid.train(_table(spark, sf_dir, "documents").select("text", "lang"))
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return langid.identify_pages(pages, model).withColumn("confidence", F.round("confidence", 6))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_pieces", F.xxhash64("piece_ids").alias("ids_hash"), "round_trip")


def op5_sharding(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_rows(docs, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    items = _table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontam.judge(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


#: The rules that ``op7_url_filter`` judges by.
URL_RULES = ["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list has the URLs of the pages whose ``page_id`` is divisible by 50."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(F.col("page_id") % 50 == 0).select("url")
    rules = urlfilter.parse_rules(URL_RULES)
    return urlfilter.judge(pages, rules, listed).select("page_id", "host", "path", "rule", "verdict")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.judge(docs).select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op10_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        bpe.token_counts(F.col("text"), public_tokenizers.path("word_bpe_49k.json")).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


QUERIES = {
    "op1_warc_index": op1_warc_index,
    "op2_preferences": op2_preferences,
    "op3_language_id": op3_language_id,
    "op4_pieces": op4_pieces,
    "op5_sharding": op5_sharding,
    "op6_decontamination": op6_decontamination,
    "op7_url_filter": op7_url_filter,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL = {
    "op1_warc_index": r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, sha1(coalesce(html, '')) AS hex, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
    substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', hex[i]) - 1) + 1, 4)), '') AS bits FROM p),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(1, 6), lambda j: substr(bits, 5 * i + j, 1)::INT * (1 << (5 - j))))::INT, 1)), '') AS payload_digest FROM b),
k AS (SELECT *, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([/?]?[^#]*)', 1) AS rest,
    strftime(make_timestamp((1700000000 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM d),
u AS (SELECT *, CASE WHEN contains(url, '://') AND NOT ends_with(url, '://')
    THEN array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || lower(rest) ELSE '' END AS url_key,
    min(page_id) OVER (PARTITION BY hex) AS first FROM k)
SELECT page_id, n AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, url_key, captured,
  row_number() OVER (ORDER BY url_key COLLATE "binary", captured, page_id::VARCHAR) - 1 AS capture_order
FROM u
""",
    "op2_preferences": r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
    FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS size FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT conv_id // 2 AS pair_id FROM c),
d AS (SELECT a.conv_id // 2 AS pair_id, min(a.n) AS n FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id + 1 AND b.n = a.n
    AND b.role = a.role AND b.text = a.text WHERE a.conv_id % 2 = 0 AND b.n IS NULL GROUP BY 1),
l AS (SELECT p.pair_id, a.conv_id AS a, b.conv_id AS b, CASE WHEN a.conv_id IS NULL OR b.conv_id IS NULL THEN 0
    ELSE least(coalesce(d.n - 1, a.size), b.size) END::INT AS k
    FROM p LEFT JOIN c a ON a.conv_id = 2 * p.pair_id LEFT JOIN c b ON b.conv_id = 2 * p.pair_id + 1 LEFT JOIN d ON d.pair_id = p.pair_id),
r AS (SELECT *, '<|turn:' || replace(role, '<|', '< |') || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS s,
    CASE WHEN role = 'assistant' THEN length(replace(text, '<|', '< |')) + 8 ELSE 0 END AS m FROM t),
o AS (SELECT l.pair_id, r.conv_id, coalesce(string_agg(s, '' ORDER BY n) FILTER (n <= k), '') AS head,
    coalesce(string_agg(s, '' ORDER BY n) FILTER (n > k), '') AS tail, coalesce(sum(m) FILTER (n > k), 0)::BIGINT AS trained
    FROM l JOIN r ON r.conv_id = l.a OR r.conv_id = l.b GROUP BY ALL)
SELECT l.pair_id, l.k AS n_prompt_turns, sha256(coalesce(x.head, y.head)) AS prompt_sha256, sha256(x.tail) AS chosen_sha256,
  sha256(y.tail) AS rejected_sha256, x.trained AS chosen_trained, y.trained AS rejected_trained
FROM l LEFT JOIN o x ON x.conv_id = l.a LEFT JOIN o y ON y.conv_id = l.b
""",
    "op6_decontamination": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, list_aggregate(ws[i:i + n - 1], 'string_agg', ' ') AS win FROM (
    SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i
    FROM b WHERE len(ws) > 0 AND item_id IS NOT NULL)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, list_aggregate(ws[i:i + n - 1], 'string_agg', ' ') AS win FROM (
    SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, ns WHERE len(ws) >= n)),
m AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM m) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
""",
    "op7_url_filter": r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1) AS query FROM pages),
c AS (SELECT *, array_to_string(list_filter(string_split(query, '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[^=]*|ref|fbclid|gclid)=')), '&') AS params FROM p),
k AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(host, '^(?:www|m)\.', ''), ':(?:80|443)$', '')
    || regexp_replace(path, '/$|\.html$', '') || CASE WHEN params <> '' THEN '?' || params ELSE '' END END AS canon FROM c),
rules(verdict, h, pre) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (SELECT page_id, h || pre AS rule, rules.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || pre) DESC, length(h) DESC) AS n
    FROM k JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)),
listed AS (SELECT DISTINCT canon FROM k WHERE page_id % 50 = 0 AND canon <> '')
SELECT k.page_id, host, path, rule, coalesce(fit.verdict, CASE WHEN listed.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN fit ON fit.page_id = k.page_id AND n = 1 LEFT JOIN listed ON listed.canon = k.canon
""",
    "op8_near_duplicates": r"""
WITH RECURSIVE d AS (SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(ws[i:i + 4], 'string_agg', ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(m.b, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
""",
    "op9_quality_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
tri AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM pos),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM tri) WHERE c >= 2),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN dup USING (r) LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM m),
h AS (SELECT source AS host, count(*) AS n, sum(base_failed::INT) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
pr AS (SELECT sum(f) / sum(n) AS m, coalesce(var_pop(f / n), 0) AS v FROM h),
k AS (SELECT m, CASE WHEN v <= 0 THEN 10000 ELSE greatest(1, least(10000, m * (1 - m) / v - 1)) END AS k FROM pr),
bad AS (SELECT host FROM h, k WHERE (f + m * k) / (n + k) > 0.9)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND bad.host IS NULL AS kept
FROM b LEFT JOIN bad ON b.source = bad.host
""",
}
