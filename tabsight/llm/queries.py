"""Queries over the given tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm import (bpe_words, chat, decontaminate, exact_dedup, fingerprint, language, merkle, ngram_join, packing,
                          quality, runs, tokens, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


@query("op1_token_counts")
def op1(spark, sf_dir):
    return tokens.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query("op2_quality_crf")
def op2(spark, sf_dir):
    return quality.classify_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op3_bpe_words")
def op3(spark, sf_dir):
    out = bpe_words.encode_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_order_minhash")
def op4(spark, sf_dir):
    return fingerprint.fingerprints(documents(spark, sf_dir))


@query("op5_language_kernels")
def op5(spark, sf_dir):
    return language.identify_language(documents(spark, sf_dir, "doc_id", "text", "lang"))


@query("op6_tool_calls", r"""
WITH u AS (SELECT conv_id, turn, text, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS g
           FROM conversations WHERE role = 'user'),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, g ORDER BY turn) - 1 AS level FROM u),
r AS (SELECT conv_id, turn - 1 AS turn, min(text) AS result FROM conversations WHERE role = 'assistant' GROUP BY ALL)
SELECT l.conv_id, l.turn, l.conv_id || ':' || l.turn AS call_id, 'reply' AS name, CAST(l.level AS INTEGER) AS level,
       r.turn IS NOT NULL AS linked, coalesce(l.text, '') <> '' AS valid,
       CASE WHEN l.text IS NULL THEN '$.prompt: not string' WHEN l.text = '' THEN '$.prompt: too short' ELSE '' END AS errors,
       '{"arguments":{"prompt":' || coalesce(CAST(to_json(l.text) AS VARCHAR), 'null') || '},"depends_on":['
       || CASE WHEN l.turn >= 2 THEN '"' || l.conv_id || ':' || (l.turn - 2) || '"' ELSE '' END
       || '],"id":"' || l.conv_id || ':' || l.turn || '","name":"reply","result":'
       || coalesce(CAST(to_json(r.result) AS VARCHAR), 'null') || '}' AS json
FROM l LEFT JOIN r USING (conv_id, turn)
""")
def op6(spark, sf_dir):
    calls, results = chat.conversation_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.link_calls(calls, results, chat.REPLY).withColumn("errors", F.array_join("errors", "; "))


@query("op6_other_turns", r"""
WITH u AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, min(text) AS result FROM conversations WHERE role = 'assistant' GROUP BY ALL)
SELECT c.conv_id, c.turn, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS INTEGER) AS level,
       false AS linked, CAST(NULL AS BOOLEAN) AS valid, '' AS errors,
       '{"role":' || coalesce(CAST(to_json(c.role) AS VARCHAR), 'null') || ',"text":'
       || coalesce(CAST(to_json(c.text) AS VARCHAR), 'null') || '}' AS json
FROM conversations c LEFT JOIN u ON c.conv_id = u.conv_id AND c.turn - 1 = u.turn
LEFT JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn
WHERE c.role IS NULL OR c.role NOT IN ('user', 'assistant')
   OR c.role = 'assistant' AND (u.turn IS NULL OR c.text IS DISTINCT FROM r.result)
""")
def op6_other(spark, sf_dir):
    rows = chat.other_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return rows.withColumn("errors", F.array_join("errors", "; "))


#: The rules of the URL filter; the longest that fits decides.
URL_RULES = [url_filter.Rule("block", "net/"), url_filter.Rule("allow", "example.net/en/"),
             url_filter.Rule("block", "example.com/de/"), url_filter.Rule("allow", "org/fr/")]


@query("op10_url_trees")
def op10(spark, sf_dir):
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), URL_RULES)


@query("op8_exact_dedup", r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
""")
def op8(spark, sf_dir):
    out = exact_dedup.exact_duplicates(documents(spark, sf_dir))
    return out.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@query("op9_sum_of_squares_packing")
def op9(spark, sf_dir):
    return packing.with_checksums(packing.pack_documents(
        documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


@query("op7_prefix_tree_join")
def op7(spark, sf_dir):
    return ngram_join.near_duplicates(documents(spark, sf_dir))


#: CRC-32 of an ASCII text ``{0}``, as DuckDB SQL.
CRC32 = """xor(4294967295, list_reduce(list_transform(string_split({0}, ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
    lambda crc, byte: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda c, b: CASE WHEN c & 1 = 1
      THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, byte)), CAST(4294967295 AS BIGINT)))"""



@query("op11_periodic_runs", r"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         @crc AS h FROM documents),
sized AS (SELECT rid, doc_id, words, len(words) AS n, h, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a
          FROM split),
docs AS (
  SELECT rid, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
           CASE WHEN i < a THEN words[i + 1]
                ELSE words[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END)
         ELSE words END AS words, n FROM sized),
spots AS (SELECT rid, n, unnest(range(n)) AS i, unnest(words) AS w FROM docs),
equal AS (SELECT x.rid, y.i - x.i AS period, x.i FROM spots x
          JOIN spots y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY rid, period ORDER BY i) AS island FROM equal),
held AS (SELECT rid, period, min(i) AS start, count(*) + period AS length FROM islands GROUP BY rid, period, island),
runs AS (SELECT rid, start, length, min(period) AS period FROM held
         WHERE length >= greatest(6, 4 * period) GROUP BY rid, start, length),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (
           PARTITION BY rid ORDER BY length / period DESC, start, period) = 1),
lines AS (SELECT rid, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), ''
                                                ORDER BY start, period) AS text FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS text FROM spots ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT d.doc_id, coalesce(l.n, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
       sha256(coalesce(l.text, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM docs d LEFT JOIN best b USING (rid) LEFT JOIN lines l USING (rid) LEFT JOIN kept k USING (rid)
""".replace("@crc", CRC32.format("CAST(doc_id AS VARCHAR)")))
def op11(spark, sf_dir):
    return runs.run_report(documents(spark, sf_dir), change=runs.planted)


@query("op12_fm_decontamination", r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
    coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
sized AS (SELECT *, least(len(words), 10) AS size FROM items WHERE len(words) > 0),
starts AS (SELECT *, unnest(range(len(words) - size + 1)) AS pos FROM sized),
windows AS (SELECT DISTINCT item, size, array_to_string(words[pos + 1:pos + size], ' ') AS phrase FROM starts),
places AS (SELECT rid, words, size, unnest(range(len(words) - size + 1)) AS pos
           FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size),
found AS (SELECT p.rid, p.pos, p.size, w.item FROM places p
          JOIN windows w ON w.size = p.size AND w.phrase = array_to_string(p.words[p.pos + 1:p.pos + p.size], ' ')),
spots AS (SELECT rid, unnest(range(pos, pos + size)) AS spot FROM found),
hits AS (SELECT rid, count(DISTINCT spot) AS n FROM spots GROUP BY rid),
which AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(w.n, 0) AS n_items,
       sha256(coalesce(w.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h USING (rid) LEFT JOIN which w USING (rid)
""")
def op12(spark, sf_dir):
    return decontaminate.decontamination_report(documents(spark, sf_dir),
                                                spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op13_merkle_manifest", r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
         || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         text, CASE WHEN @crc % 5 = 0
                    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
  FROM documents),
leaves AS (
  SELECT doc_id, key, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS other FROM rows),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY key) AS n FROM leaves),
up AS (
  SELECT 0 AS lvl, key, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT lvl + 1, key, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1
  GROUP BY lvl, key, n, pos // 16),
runs AS (SELECT lvl, key, pos // 16 AS parent, list(digest ORDER BY pos) AS kids FROM up WHERE n > 1 GROUP BY ALL),
tops AS (
  SELECT key, digest, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
up2 AS (
  SELECT 0 AS lvl, pos, n, digest FROM tops
  UNION ALL
  SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM up2 WHERE n > 1
  GROUP BY lvl, n, pos // 16),
runs2 AS (SELECT lvl, pos // 16 AS parent, list(digest ORDER BY pos) AS kids FROM up2 WHERE n > 1 GROUP BY ALL),
fold AS (
  SELECT 0 AS lvl, doc_id, leaf, key, pos, other AS cur, '' AS sibs FROM placed
  UNION ALL
  SELECT f.lvl + 1, f.doc_id, f.leaf, f.key, f.pos // 16,
         sha256(array_to_string(r.kids[:f.pos % 16], '') || f.cur || array_to_string(r.kids[f.pos % 16 + 2:], '')),
         f.sibs || array_to_string(r.kids[:f.pos % 16], '') || array_to_string(r.kids[f.pos % 16 + 2:], '')
  FROM fold f JOIN runs r ON f.lvl = r.lvl AND f.key = r.key AND f.pos // 16 = r.parent),
half AS (
  SELECT f.doc_id, f.leaf, t.digest AS subroot, t.pos, f.cur, f.sibs FROM fold f JOIN tops t ON f.key = t.key
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.lvl = f.lvl AND r.key = f.key)),
fold2 AS (
  SELECT 0 AS lvl, doc_id, leaf, subroot, pos, cur, sibs FROM half
  UNION ALL
  SELECT f.lvl + 1, f.doc_id, f.leaf, f.subroot, f.pos // 16,
         sha256(array_to_string(r.kids[:f.pos % 16], '') || f.cur || array_to_string(r.kids[f.pos % 16 + 2:], '')),
         f.sibs || array_to_string(r.kids[:f.pos % 16], '') || array_to_string(r.kids[f.pos % 16 + 2:], '')
  FROM fold2 f JOIN runs2 r ON f.lvl = r.lvl AND f.pos // 16 = r.parent)
SELECT f.doc_id, f.leaf, f.subroot, u.digest AS root, sha256(f.sibs) AS proof_sha256, f.cur AS folded_root,
       f.cur = u.digest AS verified
FROM fold2 f JOIN up2 u ON u.n = 1
WHERE NOT EXISTS (SELECT 1 FROM runs2 r WHERE r.lvl = f.lvl)
""".replace("@crc", CRC32.format("CAST(doc_id AS VARCHAR)")))
def op13(spark, sf_dir):
    return merkle.verified_manifest(documents(spark, sf_dir, *merkle.FIELDS))
