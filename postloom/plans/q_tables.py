"""Queries: joins, dedupe, merge, key checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from postloom.operators import tables as TB
from postloom.plans import sqlfrag as S
from postloom.plans.q_profile import EVENT_POSTS_SQL, event_posts
from postloom.plans.registry import query, table
from postloom.plans.views import posts, with_posts

KEY = ["platform", "post_id"]


@query("author_lookup", "J1", with_posts("""
SELECT p.post_id, c.c_name AS author_name, n.n_name AS author_nation
FROM posts_v p LEFT JOIN customer c ON c.c_custkey = CAST(p.author_id AS BIGINT) + 1
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey"""))
def author_lookup(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey"), F.col("c_name").alias("author_name"), "c_nationkey")
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("author_nation"))
    authors = users.join(nations, "c_nationkey", "left")
    p = posts(spark, d).withColumn("c_custkey", F.col("author_id").cast("long") + 1)
    return p.join(authors, "c_custkey", "left").select("post_id", "author_name", "author_nation")


def _tag_rows(spark, d):
    return TB.hashtag_rows(posts(spark, d))


@query("hashtag_rows", "J10", with_posts(f"""
SELECT platform, post_id, unnest({S.tag_keys('text')}) AS hashtag FROM posts_v"""))
def hashtag_rows(spark, d):
    return _tag_rows(spark, d)


@query("hashtag_join", "J2", with_posts(f"""
SELECT p.post_id, p.platform, h.hashtag, p.created_at
FROM posts_v p JOIN (SELECT platform, post_id, unnest({S.tag_keys('text')}) AS hashtag FROM posts_v) h
  ON p.platform = h.platform AND p.post_id = h.post_id
WHERE h.hashtag = 'src1' ORDER BY p.created_at DESC"""))
def hashtag_join(spark, d):
    tags = _tag_rows(spark, d).filter(F.col("hashtag") == "src1")
    return (posts(spark, d).join(tags, KEY).select("post_id", "platform", "hashtag", "created_at")
            .orderBy(F.desc("created_at")))


# Posts that already have a label count as stored.
STORED_SQL = """, stored AS (SELECT p.platform, p.post_id FROM posts_v p JOIN labels l ON p.post_id = CAST(l.doc_id AS VARCHAR))
"""


def _stored(spark, d):
    lab = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("post_id"))
    return posts(spark, d).join(lab, "post_id", "left_semi").select(*KEY)


@query("new_posts_only", "J3", with_posts(STORED_SQL + """
SELECT p.platform, p.post_id FROM posts_v p ANTI JOIN stored s ON p.platform = s.platform AND p.post_id = s.post_id"""))
def new_posts_only(spark, d):
    return TB.new_only(posts(spark, d).select(*KEY), _stored(spark, d), KEY)


@query("insert_flags", "J5", with_posts(STORED_SQL + """
SELECT p.platform, p.post_id, s.post_id IS NULL AS inserted
FROM posts_v p LEFT JOIN stored s ON p.platform = s.platform AND p.post_id = s.post_id"""))
def insert_flags(spark, d):
    return TB.with_inserted_flag(posts(spark, d).select(*KEY), _stored(spark, d), KEY)


@query("saved_vs_offered", "A13", with_posts(STORED_SQL + """
SELECT CAST(count(*) AS BIGINT) AS offered, CAST(count(*) FILTER (WHERE s.post_id IS NULL) AS BIGINT) AS saved
FROM posts_v p LEFT JOIN stored s ON p.platform = s.platform AND p.post_id = s.post_id"""))
def saved_vs_offered(spark, d):
    f = TB.with_inserted_flag(posts(spark, d).select(*KEY), _stored(spark, d), KEY)
    return f.agg(F.count(F.lit(1)).alias("offered"), F.count(F.when(F.col("inserted"), 1)).alias("saved"))


@query("first_wins", "J4", """
SELECT md5(text) AS text_key, doc_id, source FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def first_wins(spark, d):
    docs = table(spark, d, "documents").select(F.md5("text").alias("text_key"), "doc_id", "source")
    return TB.first_wins(docs, ["text_key"], ["doc_id"])


@query("upsert_posts", "J6", with_posts("""
, upd AS (
  SELECT p.platform, p.post_id, CAST(l.quality AS BIGINT) AS like_count,
         CASE WHEN l.toxic = 1 THEN NULL ELSE CAST(l.toxic AS BIGINT) END AS reply_count, NULL AS text
  FROM posts_v p JOIN labels l ON p.post_id = CAST(l.doc_id AS VARCHAR)),
 ins AS (SELECT 'reddit' AS platform, 'b' || CAST(item_id AS VARCHAR) AS post_id, CAST(0 AS BIGINT) AS like_count,
         CAST(0 AS BIGINT) AS reply_count, text FROM benchmark)
SELECT coalesce(p.platform, u.platform) AS platform, coalesce(p.post_id, u.post_id) AS post_id,
  CASE WHEN u.post_id IS NOT NULL THEN u.like_count ELSE p.like_count END AS like_count,
  CASE WHEN u.post_id IS NOT NULL THEN u.reply_count ELSE p.reply_count END AS reply_count,
  CASE WHEN u.post_id IS NOT NULL AND p.post_id IS NULL THEN u.text ELSE p.text END AS text
FROM posts_v p FULL JOIN (SELECT platform, post_id, like_count, reply_count, CAST(text AS VARCHAR) AS text FROM upd
                          UNION ALL SELECT * FROM ins) u
  ON p.platform = u.platform AND p.post_id = u.post_id"""))
def upsert_posts(spark, d):
    stored = posts(spark, d).select("platform", "post_id", "like_count", "reply_count", "text")
    lab = table(spark, d, "labels")
    upd = stored.select(*KEY).join(lab.select(F.col("doc_id").cast("string").alias("post_id"), "quality", "toxic"),
                                   "post_id").select(
        *KEY, F.col("quality").cast("long").alias("like_count"),
        F.when(F.col("toxic") == 1, F.lit(None).cast("long")).otherwise(F.col("toxic").cast("long")).alias("reply_count"))
    ins = table(spark, d, "benchmark").select(
        F.lit("reddit").alias("platform"), F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("post_id"),
        F.lit(0).cast("long").alias("like_count"), F.lit(0).cast("long").alias("reply_count"), "text")
    # insert rows supply text; updates do not touch it
    merged = TB.upsert(stored, upd, KEY)
    new_rows = TB.new_only(ins, stored, KEY)
    return merged.unionByName(new_rows)


AS_OF = dt.datetime(2024, 2, 1)
MID = dt.datetime(2024, 1, 16)


def _cursor_parts(spark, d):
    ev = event_posts(spark, d)
    mid = F.lit(MID.isoformat(sep=" ")).cast("timestamp_ntz")

    def agg(df):
        newest = F.max_by(F.struct("post_id", "created_at", "value"), F.struct("created_at", "event_id"))
        return df.groupBy("platform", "query").agg(newest.alias("r")).select(
            "platform", "query", F.col("r.post_id").alias("last_post_id"), F.col("r.created_at").alias("last_timestamp"),
            F.when(F.col("r.value") < 100, F.lit("")).otherwise(F.concat(F.lit("c"), F.col("r.post_id"))).alias("cursor"))

    return agg(ev.filter(F.col("created_at") < mid)), agg(ev.filter(F.col("created_at") >= mid))


CURSOR_SQL = EVENT_POSTS_SQL + """, part AS (
  SELECT platform, query, created_at < TIMESTAMP '2024-01-16 00:00:00' AS is_old,
    arg_max(post_id, (created_at, event_id)) AS last_post_id, max(created_at) AS last_timestamp,
    CASE WHEN arg_max(value, (created_at, event_id)) < 100 THEN '' ELSE 'c' || arg_max(post_id, (created_at, event_id)) END AS cursor
  FROM ev GROUP BY platform, query, created_at < TIMESTAMP '2024-01-16 00:00:00'),
 o AS (SELECT * FROM part WHERE is_old), n AS (SELECT * FROM part WHERE NOT is_old)
"""


@query("cursor_merge", "J7", f"""WITH {CURSOR_SQL.lstrip(', ')}
SELECT coalesce(o.platform, n.platform) AS platform, coalesce(o.query, n.query) AS query,
  CASE WHEN n.last_post_id IS NULL OR n.last_post_id = '' THEN o.last_post_id ELSE n.last_post_id END AS last_post_id,
  CASE WHEN n.last_timestamp IS NULL THEN o.last_timestamp ELSE n.last_timestamp END AS last_timestamp,
  CASE WHEN n.cursor IS NULL OR n.cursor = '' THEN o.cursor ELSE n.cursor END AS cursor,
  CASE WHEN n.platform IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE NULL END AS updated_at
FROM o FULL JOIN n ON o.platform = n.platform AND o.query = n.query""")
def cursor_merge(spark, d):
    old, new = _cursor_parts(spark, d)
    return TB.cursor_merge(old, new, ["platform", "query"], ["last_post_id", "last_timestamp", "cursor"],
                           F.lit(AS_OF.isoformat(sep=" ")).cast("timestamp_ntz"))


@query("cursor_advance", "J9", f"""WITH {CURSOR_SQL.lstrip(', ')},
 b AS (SELECT platform, query, arg_max(post_id, (created_at, event_id)) AS last_post_id, max(created_at) AS last_timestamp
       FROM ev WHERE value > 250 GROUP BY platform, query)
SELECT coalesce(o.platform, b.platform) AS platform, coalesce(o.query, b.query) AS query,
  CASE WHEN o.last_timestamp IS NULL OR (b.last_timestamp IS NOT NULL AND b.last_timestamp > o.last_timestamp)
       THEN b.last_post_id ELSE o.last_post_id END AS last_post_id,
  CASE WHEN o.last_timestamp IS NULL OR (b.last_timestamp IS NOT NULL AND b.last_timestamp > o.last_timestamp)
       THEN b.last_timestamp ELSE o.last_timestamp END AS last_timestamp
FROM o FULL JOIN b ON o.platform = b.platform AND o.query = b.query""")
def cursor_advance(spark, d):
    # old cursor = state after the first half; the batch (high-value events of the
    # whole month) is older than the cursor for some keys and newer for others
    old, _ = _cursor_parts(spark, d)
    ev = event_posts(spark, d).filter(F.col("value") > 250)
    batch = TB.newest_per_key(ev, ["platform", "query"], "post_id", "created_at")
    return TB.advance_cursor(old, batch, ["platform", "query"])


@query("prediction_writeback", "J12", with_posts("""
SELECT p.post_id, p.platform,
  CASE l.toxic WHEN 1 THEN 'negative' WHEN 0 THEN 'neutral' END AS sentiment,
  CASE l.quality WHEN 1 THEN 'high_quality' WHEN 0 THEN 'low_quality' END AS category
FROM posts_v p LEFT JOIN labels l ON p.post_id = CAST(l.doc_id AS VARCHAR)"""))
def prediction_writeback(spark, d):
    p = posts(spark, d).select("post_id", "platform", F.lit(None).cast("string").alias("sentiment"),
                               F.lit(None).cast("string").alias("category"))
    pred = table(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("post_id"),
        F.when(F.col("toxic") == 1, "negative").when(F.col("toxic") == 0, "neutral").alias("sentiment"),
        F.when(F.col("quality") == 1, "high_quality").when(F.col("quality") == 0, "low_quality").alias("category"))
    return TB.writeback(p, pred, ["post_id"], ["sentiment", "category"])


@query("duplicate_keys", "D1", """
SELECT md5(text) AS text_key, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1""")
def duplicate_keys(spark, d):
    return TB.key_violations(table(spark, d, "documents"), [F.md5("text").alias("text_key")])


@query("orphan_prune", "D2", """
SELECT l.doc_id, l.quality, l.toxic FROM labels l SEMI JOIN documents d
  ON l.doc_id = d.doc_id AND length(d.text) BETWEEN 10 AND 1000""")
def orphan_prune(spark, d):
    parents = table(spark, d, "documents").filter(F.length("text").between(10, 1000)).select("doc_id")
    return TB.prune_orphans(table(spark, d, "labels"), parents, ["doc_id"])


@query("merge_by_key", "S8", """
WITH old AS (SELECT doc_id, source AS value, 0 AS v FROM documents),
     new AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS value, 1 AS v FROM labels)
SELECT doc_id, arg_max(value, v) AS value FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY doc_id""")
def merge_by_key(spark, d):
    old = table(spark, d, "documents").select("doc_id", F.col("source").alias("value"))
    new = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("value"))
    return TB.latest_wins(old, new, ["doc_id"])


# Copies of a text share a key: batches, updates, predictions and new rows that repeat keys.
COPIES_SQL = """, cp AS (SELECT md5(text) AS text_key, doc_id, source, lang FROM documents),
 st AS (SELECT DISTINCT text_key FROM cp WHERE lang = 'en'),
 lab AS (SELECT cp.text_key, l.doc_id, l.quality, l.toxic, cp.source FROM labels l JOIN cp USING (doc_id)),
 last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text_key ORDER BY doc_id DESC) AS rn FROM lab) WHERE rn = 1)
"""


def _copies(spark, d):
    return table(spark, d, "documents").select(F.md5("text").alias("text_key"), "doc_id", "source", "lang")


def _labels_by_text(spark, d):
    return table(spark, d, "labels").join(_copies(spark, d).select("doc_id", "text_key", "source"), "doc_id").select("text_key", "doc_id", "quality", "toxic", "source")


@query("insert_flags_repeats", "J5/A13", f"""WITH {COPIES_SQL.lstrip(', ')}
SELECT doc_id, text_key NOT IN (SELECT text_key FROM st) AND row_number() OVER (PARTITION BY text_key ORDER BY doc_id) = 1 AS inserted FROM cp""")
def insert_flags_repeats(spark, d):
    c = _copies(spark, d)
    return TB.with_inserted_flag(c, c.where("lang = 'en'"), ["text_key"], ["doc_id"]).select("doc_id", "inserted")


@query("upsert_repeats", "J6", f"""WITH {COPIES_SQL.lstrip(', ')}
SELECT coalesce(st.text_key, last.text_key) AS text_key, last.quality, CASE WHEN last.text_key IS NULL THEN 'stored' ELSE last.source END AS source
FROM st FULL JOIN last ON st.text_key = last.text_key""")
def upsert_repeats(spark, d):
    stored = _copies(spark, d).where("lang = 'en'").select("text_key").distinct().select("text_key", F.lit(None).cast("int").alias("quality"), F.lit("stored").alias("source"))
    updates = _labels_by_text(spark, d).select("text_key", "quality", "source", "doc_id")
    return TB.upsert(stored, updates, ["text_key"], order=["doc_id"])


@query("upsert_tags", "J6/J10", with_posts(f"""
, old AS (SELECT * FROM posts_v WHERE language = 'en'), upd AS (SELECT * FROM posts_v WHERE author_id <> '7')
SELECT platform, post_id, unnest({S.tag_keys('text')}) AS hashtag FROM old
UNION ALL SELECT u.platform, u.post_id, unnest({S.tag_keys('u.text')}) AS hashtag FROM upd u ANTI JOIN old ON old.platform = u.platform AND old.post_id = u.post_id"""))
def upsert_tags(spark, d):
    p = posts(spark, d).select(*KEY, "text", "language", "author_id")
    old = p.where("language = 'en'").select(*KEY, "text")
    updates = p.where("author_id <> '7'").select(*KEY, "text")
    return TB.upsert_with_tags(old, TB.hashtag_rows(old), updates, KEY)[1]


@query("writeback_repeats", "J12", f"""WITH {COPIES_SQL.lstrip(', ')}
SELECT cp.doc_id, CASE WHEN last.quality = 1 THEN 'high' WHEN last.quality = 0 THEN 'low' ELSE 'none' END AS category
FROM cp LEFT JOIN last ON cp.text_key = last.text_key""")
def writeback_repeats(spark, d):
    pred = _labels_by_text(spark, d).select("text_key", "doc_id", F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("category"))
    c = _copies(spark, d).select("text_key", "doc_id", F.lit("none").alias("category"))
    return TB.writeback(c, pred, ["text_key"], ["category"], order=["doc_id"]).select("doc_id", "category")


@query("merge_repeats", "S8", f"""WITH {COPIES_SQL.lstrip(', ')}
SELECT text_key, 'old' AS value FROM st WHERE text_key NOT IN (SELECT text_key FROM lab)
UNION ALL SELECT text_key, source AS value FROM last""")
def merge_repeats(spark, d):
    old = _copies(spark, d).where("lang = 'en'").select("text_key").distinct().withColumn("value", F.lit("old"))
    new = _labels_by_text(spark, d).select("text_key", F.col("source").alias("value"), "doc_id")
    return TB.latest_wins(old, new, ["text_key"], order=["doc_id"])
