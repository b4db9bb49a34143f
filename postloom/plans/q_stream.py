"""Queries: Structured Streaming ingest over landing folders written from the
driver tables (X1-X6, J3/J4 across runs, N5, S4).

One store is filled per session and data folder (two deliveries of every payload,
with broken lines among them); the queries read its tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.plans.q_normalize import INGEST, bluesky_payloads, reddit_payloads, twitter_payloads
from postloom.plans.registry import query, spread, table
from postloom.session import discard, exists, materialize, scratch_path, shuffles_released
from postloom.sources import payloads as PL
from postloom.streaming.ingest import Store, cursors, run_ingest, run_log

BUILDERS = {"twitter": twitter_payloads, "reddit": reddit_payloads, "bluesky": bluesky_payloads}
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}  # of the landing files
_stores: dict[tuple[str, str], Store] = {}


def _land(spark, d, docs, root: str):
    """Write payload lines per platform and query (the document's language): every document, and
    a broken line for every 50th; the second drop delivers every line again (new files, same posts)."""
    landing = {}
    for platform, build in BUILDERS.items():
        path = f"{root}/landing/{platform}"
        lines = build(spark, d, docs.withColumn("query", F.col("lang")), keep=("query",)).select(F.col("raw_json").alias("value"), "query")
        broken = docs.where("doc_id % 50 = 0").select(F.format_string('{"broken": %d', F.col("doc_id")).alias("value"), F.col("lang").alias("query"))
        with shuffles_released(spark):
            lines.unionByName(broken).write.mode("append").options(**PACKED).partitionBy("query").text(path)
        landing[platform] = path
    return landing


def store_of(spark, d) -> Store:
    key = (spark.sparkContext.applicationId, d)
    if key not in _stores or not exists(spark, _stores[key].root):
        root = scratch_path(spark, "stream")
        store = Store(f"{root}/store", buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
        # read six times: dealt out once, as one task reads a whole row group
        path = scratch_path(spark, "stream-documents")
        docs = materialize(spread(table(spark, d, "documents")), "stream-documents", path)
        for _ in range(2):
            landing = _land(spark, d, docs, root)
            run_ingest(spark, landing, store, f"{root}/checkpoint", clock=lambda: INGEST)
            discard(spark, *landing.values())  # their run has ended: no batch reads them again
        discard(spark, path)
        _stores[key] = store
    return _stores[key]


ACCEPTED_SQL = """, acc AS (
  SELECT 'twitter' AS platform, CAST(doc_id AS VARCHAR) AS post_id, doc_id, lang FROM documents
  UNION ALL SELECT 'reddit', 'r' || CAST(doc_id AS VARCHAR), doc_id, lang FROM documents WHERE doc_id % 17 <> 0
  UNION ALL SELECT 'bluesky', 'b' || CAST(doc_id AS VARCHAR), doc_id, lang FROM documents WHERE doc_id % 19 <> 0),
 broken AS (SELECT p.platform, doc_id, lang FROM documents, (VALUES ('twitter'), ('reddit'), ('bluesky')) p(platform) WHERE doc_id % 50 = 0),
 lines AS (SELECT p.platform, lang FROM documents, (VALUES ('twitter'), ('reddit'), ('bluesky')) p(platform)
           UNION ALL SELECT platform, lang FROM broken)
"""


@query("stream_ingest", "X1/X2/X3/X4/X6/J3/J4/S4", f"""WITH {ACCEPTED_SQL.lstrip(', ')}
SELECT platform, post_id FROM acc""")
def stream_ingest(spark, d):
    store = store_of(spark, d)
    return PL.scan_posts(spark, f"{store.root}/posts", [store.folder("posts", *b) for b in store.committed(spark)]).select("platform", "post_id")


@query("stream_run_log", "X5/A11/A13", f"""WITH {ACCEPTED_SQL.lstrip(', ')},
 o AS (SELECT platform, lang AS query, CAST(2 * count(*) AS BIGINT) AS offered FROM lines GROUP BY ALL),
 s AS (SELECT platform, lang AS query, CAST(count(*) AS BIGINT) AS saved FROM acc GROUP BY ALL)
SELECT o.platform, o.query, 'ok' AS status, offered, offered - 2 * saved AS rejected, saved, CAST(2 AS BIGINT) AS batches
FROM o JOIN s ON o.platform = s.platform AND o.query = s.query""")
def stream_run_log(spark, d):
    log = run_log(spark, store_of(spark, d))
    return log.groupBy("platform", "query", "status").agg(
        F.sum("offered").cast("long").alias("offered"), F.sum("rejected").cast("long").alias("rejected"), F.sum("saved").cast("long").alias("saved"),
        F.countDistinct("run_id", "batch_id").cast("long").alias("batches"))


@query("stream_dedupe", "X3", f"""WITH {ACCEPTED_SQL.lstrip(', ')}
SELECT platform, CAST(count(*) AS BIGINT) AS stored, CAST(count(*) AS BIGINT) AS keys FROM acc GROUP BY platform""")
def stream_dedupe(spark, d):
    posts = store_of(spark, d).read(spark, "posts")
    return posts.groupBy("platform").agg(F.count(F.lit(1)).alias("stored"), F.countDistinct("post_id").alias("keys"))


@query("stream_rejects", "N5/X4", f"""WITH {ACCEPTED_SQL.lstrip(', ')}
SELECT platform, 'malformed payload' AS reject_reason, '{{"broken": ' || doc_id AS raw, CAST(2 AS BIGINT) AS n FROM broken
UNION ALL SELECT 'reddit', 'missing id', NULL, CAST(2 * count(*) AS BIGINT) FROM documents WHERE doc_id % 17 = 0 HAVING count(*) > 0
UNION ALL SELECT 'bluesky', 'empty post id', NULL, CAST(2 * count(*) AS BIGINT) FROM documents WHERE doc_id % 19 = 0 HAVING count(*) > 0""")
def stream_rejects(spark, d):
    bad = store_of(spark, d).read(spark, "rejects")
    raw = F.when(F.col("reject_reason") == "malformed payload", F.col("raw_json"))
    return bad.groupBy("platform", "reject_reason", raw.alias("raw")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_cursors", "X2/J7/J9/P4/P5/P6", f"""WITH {ACCEPTED_SQL.lstrip(', ')},
 timed AS (SELECT platform, lang AS query, post_id, CASE platform WHEN 'reddit' THEN make_timestamp((1704067200 + doc_id * 60) * 1000000 + 500000)
             ELSE CASE WHEN platform = 'twitter' AND doc_id % 6 = 2 THEN TIMESTAMP '2024-01-02 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE END END AS ts
           FROM acc WHERE NOT (platform = 'twitter' AND doc_id % 6 IN (0, 1)) AND NOT (platform = 'bluesky' AND doc_id % 4 = 0))
SELECT platform, query, arg_max(post_id, (ts, post_id)) AS last_post_id, epoch_us(max(ts)) AS last_us FROM timed GROUP BY platform, query""")
def stream_cursors(spark, d):
    store = store_of(spark, d)
    return cursors(spark, store).select("platform", "query", "last_post_id", F.unix_micros("last_timestamp").alias("last_us"))
