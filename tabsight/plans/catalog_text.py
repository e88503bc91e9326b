"""Phase 2 queries: words, word weights, token statistics, TF-IDF."""

from __future__ import annotations

from tabsight.functions.text import ENGLISH_STOP_WORDS, STOP_WORDS_TOP, WORD_SPLIT
from tabsight.operators import text as X
from tabsight.plans.registry import query, table


def _sql_list(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _words_sql(tbl, col):
    return f"""(SELECT w AS word FROM (
  SELECT unnest(regexp_split_to_array(lower({col}), '{WORD_SPLIT}')) AS w FROM {tbl}) t
  WHERE regexp_full_match(w, '[a-z]{{3,}}') AND NOT list_contains({_sql_list(STOP_WORDS_TOP)}, w))"""


@query("top_words", f"""
SELECT word, CAST(count(*) AS BIGINT) AS "count" FROM {_words_sql('documents', 'text')} x
GROUP BY word ORDER BY "count" DESC, word LIMIT 20
""")
def q_top_words(spark, sf_dir):
    return X.top_words(table(spark, sf_dir, "documents"), "text", 20)


@query("word_weights", f"""
WITH t AS (SELECT word, count(*) AS n FROM {_words_sql('documents', 'text')} x
           GROUP BY word ORDER BY n DESC, word LIMIT 250)
SELECT word, CAST(n AS BIGINT) AS "count", round(n / max(n) OVER (), 6) AS weight FROM t
""")
def q_word_weights(spark, sf_dir):
    return X.word_weights(table(spark, sf_dir, "documents"), "text", 250)


@query("token_stats", r"""
WITH t AS (SELECT role, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '')) AS k
           FROM conversations WHERE text IS NOT NULL)
SELECT role, CAST(count(k) AS BIGINT) AS n_texts, round(avg(k), 6) AS mean_tokens,
       CAST(min(k) AS BIGINT) AS min_tokens, CAST(max(k) AS BIGINT) AS max_tokens,
       CAST(sum(k) AS BIGINT) AS total_tokens
FROM t GROUP BY role
""")
def q_token_stats(spark, sf_dir):
    return X.token_stats(table(spark, sf_dir, "conversations"), "text", by=["role"])


def tfidf_sql(stop_words=ENGLISH_STOP_WORDS):
    stop = _sql_list(stop_words)
    return f"""
WITH tok AS (
  SELECT doc_id, t AS term FROM (
    SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '{WORD_SPLIT}')) AS t FROM documents) s
  WHERE length(t) >= 2 AND NOT list_contains({stop}, t)),
vocab AS (SELECT term FROM tok GROUP BY term ORDER BY count(*) DESC, term LIMIT 300),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM vocab) GROUP BY doc_id, term),
dfreq AS (SELECT term, count(*) AS dfreq FROM tf GROUP BY term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + dfreq)) + 1 AS idf FROM dfreq),
w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w
"""


@query("tfidf_long", tfidf_sql)
def q_tfidf_long(spark, sf_dir):
    return X.tfidf_long(table(spark, sf_dir, "documents"), "doc_id", "text", 300)
