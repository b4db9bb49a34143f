"""Driver-table stand-ins for the pipeline's own tables.

``posts`` is derived from ``documents`` (whole texts): platform skew 70/20/10,
tags in two cases, mentions, links, contractions, tri-state ``has_media`` and a
minute clock.  The same definition is given as SQL for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.plans.registry import table

POSTS_SQL = """
posts_v AS (
SELECT CAST(doc_id AS VARCHAR) AS post_id,
 CASE WHEN doc_id % 10 < 7 THEN 'bluesky' WHEN doc_id % 10 < 9 THEN 'reddit' ELSE 'twitter' END AS platform,
 text
 || CASE WHEN doc_id % 3 = 0 THEN ' #' || source || ' #' || upper(source) ELSE '' END
 || CASE WHEN doc_id % 4 = 0 THEN ' @user' || CAST(doc_id % 50 AS VARCHAR) ELSE '' END
 || CASE WHEN doc_id % 7 = 0 THEN ' https://' || source || '.example.com/' || CAST(doc_id AS VARCHAR) ELSE '' END
 || CASE WHEN doc_id % 6 = 0 THEN ' Don''t stop, it''s fine' ELSE '' END AS text,
 lang AS language, CAST(doc_id % 50 AS VARCHAR) AS author_id,
 'user' || CAST(doc_id % 50 AS VARCHAR) AS author_username,
 CAST((doc_id % 50) * 37 % 1000 AS BIGINT) AS author_followers,
 CAST(doc_id % 97 AS BIGINT) AS like_count, CAST(doc_id % 13 AS BIGINT) AS reply_count,
 CASE WHEN doc_id % 10 = 0 THEN true WHEN doc_id % 10 = 1 THEN NULL ELSE false END AS has_media,
 TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS created_at
FROM documents)
"""


def with_posts(sql: str) -> str:
    """Prefix an oracle query with the ``posts_v`` CTE (the query may add more CTEs
    by starting with ``, name AS (...)``)."""
    return "WITH " + POSTS_SQL.strip() + "\n" + sql.strip()


def posts_from_documents(documents: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    src = F.col("source")
    m10 = d % 10
    text = F.concat(
        F.col("text"),
        F.when(d % 3 == 0, F.concat(F.lit(" #"), src, F.lit(" #"), F.upper(src))).otherwise(F.lit("")),
        F.when(d % 4 == 0, F.concat(F.lit(" @user"), (d % 50).cast("string"))).otherwise(F.lit("")),
        F.when(d % 7 == 0, F.concat(F.lit(" https://"), src, F.lit(".example.com/"), d.cast("string"))).otherwise(F.lit("")),
        F.when(d % 6 == 0, F.lit(" Don't stop, it's fine")).otherwise(F.lit("")),
    )
    return documents.select(
        d.cast("string").alias("post_id"),
        F.when(m10 < 7, "bluesky").when(m10 < 9, "reddit").otherwise("twitter").alias("platform"),
        text.alias("text"),
        F.col("lang").alias("language"),
        (d % 50).cast("string").alias("author_id"),
        F.concat(F.lit("user"), (d % 50).cast("string")).alias("author_username"),
        ((d % 50) * 37 % 1000).cast("long").alias("author_followers"),
        (d % 97).cast("long").alias("like_count"),
        (d % 13).cast("long").alias("reply_count"),
        F.when(m10 == 0, F.lit(True)).when(m10 == 1, F.lit(None).cast("boolean")).otherwise(F.lit(False)).alias("has_media"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=d.cast("int"))).alias("created_at"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts_from_documents(table(spark, sf_dir, "documents"))
