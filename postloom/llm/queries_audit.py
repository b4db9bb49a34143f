"""Query of the filter interaction audit."""

from __future__ import annotations

from postloom.llm.filter_audit import filter_audit
from postloom.llm.registry import query, read

OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
f AS (SELECT doc_id, part,
        CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS m FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, m, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, m),
bits AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, b)),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS o, [a.b, b.b, c.b, d.b, e.b] AS bs FROM bits a, bits b, bits c, bits d, bits e
           WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
steps AS (SELECT o, s AS step, bs[s] AS own, coalesce(list_sum(bs[1 : s - 1]), 0) AS before FROM orders, range(1, 6) r(s)),
parts AS (SELECT DISTINCT part FROM f),
res AS (SELECT p.part, o, step, own,
          sum(CASE WHEN (m & CAST(before + own AS INTEGER)) = 0 THEN n ELSE 0 END) AS kept,
          sum(CASE WHEN (m & CAST(before AS INTEGER)) = 0 AND (m & own) <> 0 THEN n ELSE 0 END) AS removed,
          sum(CASE WHEN (m & CAST(before AS INTEGER)) <> 0 AND (m & own) <> 0 THEN n ELSE 0 END) AS redundant,
          sum(CASE WHEN m = own THEN n ELSE 0 END) AS unique_fails,
          sum(CASE WHEN (m & CAST(before AS INTEGER)) = 0 AND (m & own) <> 0 THEN good ELSE 0 END) AS good_lost,
          sum(CASE WHEN (m & CAST(before AS INTEGER)) = 0 AND (m & own) <> 0 THEN toxic ELSE 0 END) AS toxic_lost
        FROM parts p, steps, cells WHERE cells.part = p.part GROUP BY ALL)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM res
"""


@query("op11_filter_audit", OP11_SQL)
def op11_filter_audit(spark, sf_dir):
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
