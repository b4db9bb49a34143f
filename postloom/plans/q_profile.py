"""Queries: filters (P1-P8) and audit aggregates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from postloom import config
from postloom.functions import text as T
from postloom.operators import filters as FL
from postloom.operators import profile as PR
from postloom.plans import sqlfrag as S
from postloom.plans.registry import query, table
from postloom.plans.views import posts, with_posts

LO, HI = config.MIN_TEXT_LENGTH, config.MAX_TEXT_LENGTH
P1_SQL = f"text IS NOT NULL AND trim(text) <> '' AND length(text) BETWEEN {LO} AND {HI}"
P2_SQL = f"{S.strip("coalesce(text, '')")} <> '' AND length(coalesce(text, '')) BETWEEN {LO} AND {HI}"


@query("pool_filter_sql", "P1/N11", with_posts(f"""
SELECT post_id, platform, CAST(length(text) AS BIGINT) AS text_length FROM posts_v WHERE {P1_SQL}"""))
def pool_filter_sql(spark, d):
    return FL.pool_filter_sql(posts(spark, d)).select("post_id", "platform", T.text_length("text").alias("text_length"))


@query("pool_filter_strip", "P2", f"""
SELECT doc_id, CAST(length(text) AS BIGINT) AS text_length FROM documents WHERE {P2_SQL}""")
def pool_filter_strip(spark, d):
    return FL.pool_filter_strip(table(spark, d, "documents")).select("doc_id", T.text_length("text").alias("text_length"))


@query("example_filter", "P3", with_posts(f"""
SELECT post_id, platform, CAST(length(text) AS BIGINT) AS text_length FROM posts_v
WHERE text IS NOT NULL AND trim(text) <> '' AND length(text) BETWEEN 101 AND 400
  AND platform = 'reddit' AND (has_media = false OR has_media IS NULL)"""))
def example_filter(spark, d):
    return FL.example_filter(posts(spark, d), "reddit", 101, 400).select(
        "post_id", "platform", T.text_length("text").alias("text_length"))


# Events stand in for a post stream: platform = event type, query = user.
EVENT_POSTS_SQL = """, ev AS (SELECT event_id, CAST(event_id AS VARCHAR) AS post_id, event_type AS platform,
  'u' || CAST(user_id AS VARCHAR) AS query, ts AS created_at, value FROM events),
 state AS (SELECT platform, query, max(created_at) AS last_timestamp, CAST(max(event_id) AS VARCHAR) AS last_post_id
           FROM ev WHERE created_at < TIMESTAMP '2024-01-10 00:00:00' GROUP BY platform, query)
"""
CUTOFF = dt.datetime(2024, 1, 10)


def event_posts(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.col("event_id").cast("string").alias("post_id"), F.col("event_type").alias("platform"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("query"), F.col("ts").alias("created_at"), "value")


def event_state(spark, d):
    ev = event_posts(spark, d)
    return ev.filter(F.col("created_at") < F.lit(CUTOFF.isoformat(sep=" ")).cast("timestamp_ntz")).groupBy("platform", "query").agg(
        F.max("created_at").alias("last_timestamp"), F.max("event_id").cast("string").alias("last_post_id"))


@query("incremental_filter", "P4/P5/J8", f"""WITH {EVENT_POSTS_SQL.lstrip(', ')}
SELECT ev.event_id, ev.platform, ev.query, s.last_timestamp IS NOT NULL AS had_cursor
FROM ev LEFT JOIN state s ON ev.platform = s.platform AND ev.query IS NOT DISTINCT FROM s.query
WHERE s.last_timestamp IS NULL OR ev.created_at > s.last_timestamp OR ev.created_at IS NULL""")
def incremental_filter(spark, d):
    out = FL.after_cursor(event_posts(spark, d), event_state(spark, d), ["platform", "query"], keep_null_ts=True)
    return out.select("event_id", "platform", "query", "had_cursor")


@query("incremental_by_id", "P6", f"""WITH {EVENT_POSTS_SQL.lstrip(', ')}
SELECT ev.event_id FROM ev LEFT JOIN state s ON ev.platform = s.platform AND ev.query = s.query
WHERE s.last_post_id IS NULL OR CAST(ev.post_id AS DECIMAL(20,0)) > CAST(s.last_post_id AS DECIMAL(20,0))""")
def incremental_by_id(spark, d):
    return FL.after_id(event_posts(spark, d), event_state(spark, d), ["platform", "query"]).select("event_id")


@query("incremental_mixed_ids", "P6", """
WITH f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id || 'abc' || (doc_id % 7) WHEN doc_id % 3 = 1 THEN CAST(doc_id * 1000003 AS VARCHAR) ELSE '-' || doc_id END AS id, lang FROM documents),
 st(lang, since) AS (VALUES ('en', '100000300'), ('de', '50abc1'))
SELECT doc_id FROM f LEFT JOIN st USING (lang)
WHERE since IS NULL OR (TRY_CAST(id AS HUGEINT) IS NULL, coalesce(TRY_CAST(id AS HUGEINT), 0), CASE WHEN TRY_CAST(id AS HUGEINT) IS NULL THEN length(id) ELSE 0 END, CASE WHEN TRY_CAST(id AS HUGEINT) IS NULL THEN id ELSE '' END)
   > (TRY_CAST(since AS HUGEINT) IS NULL, coalesce(TRY_CAST(since AS HUGEINT), 0), CASE WHEN TRY_CAST(since AS HUGEINT) IS NULL THEN length(since) ELSE 0 END, CASE WHEN TRY_CAST(since AS HUGEINT) IS NULL THEN since ELSE '' END)""")
def incremental_mixed_ids(spark, d):
    i = F.col("doc_id")
    ids = F.when(i % 3 == 0, F.concat(i, F.lit("abc"), i % 7)).when(i % 3 == 1, (i * 1000003).cast("string")).otherwise(F.concat(F.lit("-"), i))
    feed = table(spark, d, "documents").select("doc_id", ids.alias("post_id"), "lang")
    state = spark.createDataFrame([("en", "100000300"), ("de", "50abc1")], "lang string, last_post_id string")
    return FL.after_id(feed, state, ["lang"]).select("doc_id")


@query("last_24h", "P7/L3", """
SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""")
def last_24h(spark, d):
    ev = table(spark, d, "events")
    as_of = ev.select(F.max("ts")).scalar()
    return FL.within_hours(ev, "ts", as_of, 24).select("event_id", "ts").orderBy(F.desc("ts"), "event_id")


@query("platform_counts", "A1", with_posts("""
SELECT platform, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM posts_v GROUP BY platform"""))
def platform_counts(spark, d):
    return PR.counts_with_share(posts(spark, d)).select("platform", "n", F.round("pct", 6).alias("pct"))


@query("pool_platform_counts", "A2", with_posts(f"""
SELECT a.platform, a.n_sql, b.n_strip FROM
 (SELECT platform, CAST(count(*) AS BIGINT) AS n_sql FROM posts_v WHERE {P1_SQL} GROUP BY platform) a
 FULL JOIN (SELECT platform, CAST(count(*) AS BIGINT) AS n_strip FROM posts_v WHERE {P2_SQL} GROUP BY platform) b
 USING (platform)"""))
def pool_platform_counts(spark, d):
    a, b = FL.in_pool_sql(), FL.in_pool_strip()
    return posts(spark, d).groupBy("platform").agg(F.count(F.when(a, 1)).alias("n_sql"), F.count(F.when(b, 1)).alias("n_strip")).where(
        "n_sql > 0 OR n_strip > 0").select("platform", F.nullif("n_sql", F.lit(0)).alias("n_sql"), F.nullif("n_strip", F.lit(0)).alias("n_strip"))


@query("platform_total", "A3/P8", with_posts("""
SELECT CAST(count(*) AS BIGINT) AS n_all, CAST(count(*) FILTER (WHERE platform = 'reddit') AS BIGINT) AS n_reddit FROM posts_v"""))
def platform_total(spark, d):
    return posts(spark, d).agg(F.count(F.lit(1)).alias("n_all"), F.count(F.when(F.col("platform") == "reddit", 1)).alias("n_reddit"))


@query("date_range", "A4", with_posts("""
SELECT 'posts' AS src, min(created_at) AS min_ts, max(created_at) AS max_ts FROM posts_v
UNION ALL SELECT 'events', min(ts), max(ts) FROM events"""))
def date_range(spark, d):
    a = PR.date_range(posts(spark, d), "created_at").select(F.lit("posts").alias("src"), "*")
    b = PR.date_range(table(spark, d, "events"), "ts").select(F.lit("events").alias("src"), "*")
    return a.unionByName(b)


@query("null_profile", "A5", with_posts("""
SELECT column_name, null_count, round(null_count * 100.0 / n, 6) AS null_pct FROM (
  SELECT 'has_media' AS column_name, CAST(count(*) FILTER (WHERE has_media IS NULL) AS BIGINT) AS null_count, count(*) AS n FROM posts_v
  UNION ALL SELECT 'text', CAST(count(*) FILTER (WHERE text IS NULL) AS BIGINT), count(*) FROM posts_v
  UNION ALL SELECT 'like_count', CAST(count(*) FILTER (WHERE like_count IS NULL) AS BIGINT), count(*) FROM posts_v
  UNION ALL SELECT 'platform', CAST(count(*) FILTER (WHERE platform IS NULL) AS BIGINT), count(*) FROM posts_v
  UNION ALL SELECT 'created_at', CAST(count(*) FILTER (WHERE created_at IS NULL) AS BIGINT), count(*) FROM posts_v
) WHERE null_count > 0"""))
def null_profile(spark, d):
    p = posts(spark, d).select("has_media", "text", "like_count", "platform", "created_at")
    return PR.null_profile(p).select("column_name", "null_count", F.round("null_pct", 6).alias("null_pct"))


@query("empty_text", "A6", with_posts(f"""
SELECT src, empty_count, round(empty_count * 100.0 / n, 6) AS empty_pct FROM (
 SELECT 'posts' AS src, CAST(count(*) FILTER (WHERE {S.strip("coalesce(text, '')")} = '') AS BIGINT) AS empty_count, count(*) AS n FROM posts_v
 UNION ALL SELECT 'conversations', CAST(count(*) FILTER (WHERE {S.strip("coalesce(text, '')")} = '') AS BIGINT), count(*) FROM conversations
 UNION ALL SELECT 'documents', CAST(count(*) FILTER (WHERE {S.strip("coalesce(text, '')")} = '') AS BIGINT), count(*) FROM documents)"""))
def empty_text(spark, d):
    parts = [PR.empty_text(posts(spark, d)).select(F.lit("posts").alias("src"), "*"),
             PR.empty_text(table(spark, d, "conversations")).select(F.lit("conversations").alias("src"), "*"),
             PR.empty_text(table(spark, d, "documents")).select(F.lit("documents").alias("src"), "*")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("src", "empty_count", F.round("empty_pct", 6).alias("empty_pct"))


@query("length_stats", "A7", with_posts("""
SELECT platform, CAST(count(*) AS BIGINT) AS n, round(avg(length(text)), 6) AS mean_len,
  CAST(median(length(text)) AS DOUBLE) AS median_len, CAST(min(length(text)) AS BIGINT) AS min_len,
  CAST(max(length(text)) AS BIGINT) AS max_len
FROM posts_v GROUP BY platform"""))
def length_stats(spark, d):
    return PR.length_stats(posts(spark, d)).withColumn("mean_len", F.round("mean_len", 6))


@query("pool_profile", "A8/S9", with_posts(f"""
SELECT CAST(count(*) AS BIGINT) AS total_samples,
  (SELECT string_agg(platform || '=' || CAST(n AS VARCHAR), ',' ORDER BY platform)
     FROM (SELECT platform, count(*) AS n FROM posts_v WHERE {P2_SQL} GROUP BY platform)) AS platforms,
  round(avg(length(text)), 6) AS mean_len, CAST(median(length(text)) AS DOUBLE) AS median_len,
  CAST(min(length(text)) AS BIGINT) AS min_len, CAST(max(length(text)) AS BIGINT) AS max_len,
  {LO} AS min_length, {HI} AS max_length
FROM posts_v WHERE {P2_SQL}"""))
def pool_profile(spark, d):
    prof = PR.pool_profile(FL.pool_filter_strip(posts(spark, d)), LO, HI)
    entries = F.transform(F.map_entries("platforms"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return prof.select(
        "total_samples", F.array_join(entries, ",").alias("platforms"),
        F.round("length_stats.mean", 6).alias("mean_len"), F.col("length_stats.median").alias("median_len"),
        F.col("length_stats.min").alias("min_len"), F.col("length_stats.max").alias("max_len"),
        "min_length", "max_length")


@query("platform_status", "A12", with_posts("""
SELECT platform, CAST(count(*) AS BIGINT) AS total_posts, max(created_at) AS newest,
  CAST(least(5, count(*)) AS BIGINT) AS recent_shown FROM posts_v GROUP BY platform"""))
def platform_status(spark, d):
    return PR.platform_status(posts(spark, d))
