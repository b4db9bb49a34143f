"""Query of the substring dedup."""

from __future__ import annotations

from postloom.llm.registry import query, read
from postloom.llm.substring_dedup import substring_dedup

OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, unnest(range(len(ws) - 19)) AS s, ws FROM w WHERE len(ws) >= 20
), keyed AS (
  SELECT doc_id, s, list_aggregate(ws[s + 1 : s + 20], 'string_agg', ' ') AS k FROM win
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS rn FROM keyed) WHERE rn > 1
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM later)
), tok AS (
  SELECT doc_id, unnest(range(len(ws))) AS p, unnest(ws) AS word FROM w
), agg AS (
  SELECT tok.doc_id, count(gone.p) AS n_removed,
         string_agg(tok.word, ' ' ORDER BY tok.p) FILTER (gone.p IS NULL) AS kept
  FROM tok LEFT JOIN gone ON tok.doc_id = gone.doc_id AND tok.p = gone.p GROUP BY tok.doc_id
)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(agg.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(agg.kept, '')) AS kept_sha256
FROM w LEFT JOIN agg ON w.doc_id = agg.doc_id
"""


@query("op1_substring_dedup", OP1_SQL)
def op1_substring_dedup(spark, sf_dir):
    return substring_dedup(read(spark, sf_dir, "documents"), with_text=False)
