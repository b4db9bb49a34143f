"""Queries: text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.functions import text as T
from postloom.plans import sqlfrag as S
from postloom.plans.registry import query, spread, table
from postloom.plans.views import posts, with_posts


@query("clean_text", "T7-T13", f"SELECT doc_id, {S.clean('text')} AS cleaned_text FROM documents")
def clean_text(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.clean_text("text").alias("cleaned_text"))


@query("clean_nonempty", "T13+P9", with_posts(f"""
SELECT post_id, platform, cleaned_text FROM (
  SELECT post_id, platform, {S.clean('text')} AS cleaned_text FROM posts_v) WHERE length(cleaned_text) > 0"""))
def clean_nonempty(spark, d):
    # cleaned once per row: a filter on the column itself would be pushed below it and clean again
    kept = F.filter(F.array(T.clean_text("text")), lambda c: F.length(c) > 0)
    return posts(spark, d).select("post_id", "platform", F.explode(kept).alias("cleaned_text"))


@query("clean_pages", "T13 on markup", f"SELECT page_id, {S.clean('html')} AS cleaned_text FROM pages")
def clean_pages(spark, d):
    return spread(table(spark, d, "pages").select("page_id", "html")).select("page_id", T.clean_text("html").alias("cleaned_text"))


@query("extract_hashtags", "T1", with_posts(f"""
SELECT post_id, array_to_string({S.tags('text')}, '|') AS hashtags, CAST(len({S.tags('text')}) AS BIGINT) AS n_hashtags
FROM posts_v"""))
def extract_hashtags(spark, d):
    tags = T.hashtags("text")
    return posts(spark, d).select("post_id", F.array_join(tags, "|").alias("hashtags"),
                                  F.size(tags).cast("long").alias("n_hashtags"))


@query("extract_mentions", "T2", with_posts(f"""
SELECT post_id, array_to_string({S.mentions('text')}, '|') AS mentions FROM posts_v"""))
def extract_mentions(spark, d):
    return posts(spark, d).select("post_id", F.array_join(T.mentions("text"), "|").alias("mentions"))


@query("extract_urls", "T3", with_posts(f"""
SELECT 'post' AS src, post_id AS id, array_to_string({S.urls('text')}, ' ') AS urls, CAST(len({S.urls('text')}) AS BIGINT) AS n_urls FROM posts_v
UNION ALL
SELECT 'page', CAST(page_id AS VARCHAR), array_to_string({S.urls('url')}, ' '), CAST(len({S.urls('url')}) AS BIGINT) FROM pages"""))
def extract_urls(spark, d):
    p = posts(spark, d).select(F.lit("post").alias("src"), F.col("post_id").alias("id"), T.urls("text").alias("u"))
    g = table(spark, d, "pages").select(F.lit("page").alias("src"), F.col("page_id").cast("string").alias("id"),
                                        T.urls("url").alias("u"))
    return p.unionByName(g).select("src", "id", F.array_join("u", " ").alias("urls"),
                                   F.size("u").cast("long").alias("n_urls"))


@query("strip_vs_trim", "T14", f"""
SELECT doc_id, trim(text) = '' AS trim_empty, {S.strip('text')} = '' AS strip_empty,
       CAST(length(trim(text)) AS BIGINT) AS trim_len, CAST(length({S.strip('text')}) AS BIGINT) AS strip_len
FROM documents""")
def strip_vs_trim(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        (T.sql_trim("text") == "").alias("trim_empty"),
        (T.unicode_strip("text") == "").alias("strip_empty"),
        F.length(T.sql_trim("text")).cast("long").alias("trim_len"),
        F.length(T.unicode_strip("text")).cast("long").alias("strip_len"),
    )


@query("array_summary", "T17/T18", """
SELECT 'embedding' AS src, vec_id AS id,
       CASE WHEN embedding IS NULL THEN 'None' ELSE '[Array of ' || CAST(len(embedding) AS VARCHAR) || ' items]' END AS summary
FROM embeddings
UNION ALL
SELECT 'props', event_id,
       CASE WHEN props IS NULL OR props = '' THEN 'None'
            WHEN NOT json_valid(props) THEN '[Invalid JSON]'
            WHEN json_type(props) = 'ARRAY' THEN '[Array of ' || CAST(json_array_length(props) AS VARCHAR) || ' items]'
            WHEN json_type(props) = 'OBJECT' THEN '[Array of ' || CAST(len(json_keys(props)) AS VARCHAR) || ' items]'
            ELSE '[Invalid JSON]' END
FROM events""")
def array_summary(spark, d):
    # embeddings are stored as native arrays; the JSON-text path is exercised on
    # the encoded array (T18) and on the ``props`` JSON column.
    e = table(spark, d, "embeddings").select(
        F.lit("embedding").alias("src"), F.col("vec_id").alias("id"),
        T.json_array_summary(F.to_json("embedding")).alias("summary"))
    p = table(spark, d, "events").select(F.lit("props").alias("src"), F.col("event_id").alias("id"),
                                         T.json_array_summary("props").alias("summary"))
    return e.unionByName(p)


@query("token_estimate", "G8", """
SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS est_tokens FROM documents""")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate("text").alias("est_tokens"))


@query("engagement_rate", "T4", with_posts("""
SELECT post_id, CASE WHEN author_followers IS NULL THEN NULL WHEN author_followers = 0 THEN 0.0
  ELSE round(CAST(like_count + reply_count AS DOUBLE) / author_followers * 100.0, 6) END AS engagement_rate
FROM posts_v"""))
def engagement_rate(spark, d):
    return posts(spark, d).select(
        "post_id", F.round(T.engagement_rate("like_count", "reply_count", "author_followers"), 6).alias("engagement_rate"))


@query("query_routing", "N8", """
SELECT doc_id,
  CASE WHEN regexp_matches(text, ' |:|"|OR|AND') THEN 'search' ELSE 'subreddit' END AS route_text,
  CASE WHEN regexp_matches(source, ' |:|"|OR|AND') THEN 'search' ELSE 'subreddit' END AS route_source
FROM documents""")
def query_routing(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", T.search_route("text").alias("route_text"), T.search_route("source").alias("route_source"))


@query("format_fields", "T5/T6/T15/T16", with_posts("""
SELECT post_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_text,
  printf('%d:%02d:%02d', CAST(floor(doc_secs / 3600) AS BIGINT), CAST(floor((doc_secs % 3600) / 60) AS BIGINT), CAST(doc_secs % 60 AS BIGINT)) AS age_text,
  split_part(url, '/', -1) AS last_segment, contains(url, '.example.com') AS is_example
FROM (SELECT p.post_id, p.created_at, CAST(floor(epoch(p.created_at) - epoch(TIMESTAMP '2024-01-01 00:00:00')) AS BIGINT) + 7 AS doc_secs,
             'https://bsky.app/profile/' || p.author_username || '/post/' || p.post_id AS url
      FROM posts_v p)"""))
def format_fields(spark, d):
    p = posts(spark, d)
    secs = (F.unix_timestamp(F.col("created_at").cast("timestamp")) - F.unix_timestamp(
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp")) + 7)
    url = F.concat(F.lit("https://bsky.app/profile/"), F.col("author_username"), F.lit("/post/"), F.col("post_id"))
    return p.select("post_id", T.format_ts("created_at").alias("created_text"),
                    T.format_duration(secs).alias("age_text"),
                    T.last_path_segment(url).alias("last_segment"),
                    url.contains(".example.com").alias("is_example"))


@query("durations", "T6", """
SELECT event_id, CASE WHEN abs(dd) = 0 THEN '' WHEN abs(dd) = 1 THEN dd || ' day, ' ELSE dd || ' days, ' END
  || printf('%d:%02d:%02d', r // 3600, (r % 3600) // 60, r % 60) AS elapsed
FROM (SELECT event_id, CAST(floor(s / 86400.0) AS BIGINT) AS dd, s - 86400 * CAST(floor(s / 86400.0) AS BIGINT) AS r
      FROM (SELECT event_id, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) - epoch(TIMESTAMP '2024-01-10 12:00:00')::BIGINT AS s FROM events))""")
def durations(spark, d):
    # event times around a fixed moment: under a day, one day, many days, and before it
    base = F.unix_timestamp(F.lit("2024-01-10 12:00:00").cast("timestamp_ntz").cast("timestamp"))
    return table(spark, d, "events").select("event_id", T.format_duration(F.unix_timestamp(F.col("ts").cast("timestamp")) - base).alias("elapsed"))
