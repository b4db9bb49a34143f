"""Query of the hard-negative mining."""

from __future__ import annotations

from postloom.llm.hard_negatives import hard_negatives
from postloom.llm.registry import query, read

OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, label, x FROM e WHERE vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL
        AND len(list_filter(x, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0),
one AS (SELECT vec_id, label, list_transform(x, lambda v: CAST(floor(256 * v) AS BIGINT)) AS q
        FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY label, x) AS k FROM u) WHERE k = 1),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS id, a.label = o.label AS same,
        CAST(coalesce(list_sum(list_transform(range(1, least(len(a.q), len(o.q)) + 1), lambda i: a.q[i] * o.q[i])), 0) AS BIGINT) AS score
      FROM one a, one o WHERE a.vec_id % 50 = 0 AND o.vec_id <> a.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score
      FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@query("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark, sf_dir):
    return hard_negatives(read(spark, sf_dir, "embeddings"))
