"""Queries: sinks written to the shared scratch folder and read back (S8
versions, S9 JSON export, S10 CSV export, S12/L4 preview)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.operators import filters as FL
from postloom.operators import sampling as SA
from postloom.plans.q_profile import P2_SQL
from postloom.plans import sqlfrag as S
from postloom.plans.q_sampling import PLAN_SQL, _md5
from postloom.plans.registry import query, spread, table
from postloom.plans.views import posts, with_posts
from postloom.session import COMPRESSION, scratch_path, shuffles_released
from postloom.sources import payloads as PL
from postloom.sources import sinks as SK
from postloom.sources.buckets import BucketTable


@query("versioned_merge", "S8", """
WITH old AS (SELECT doc_id, source AS value, 0 AS v FROM documents),
     new AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS value, 1 AS v FROM labels)
SELECT doc_id, arg_max(value, v) AS value, 1 AS version FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY doc_id""")
def versioned_merge(spark, d):
    base = scratch_path(spark, "versions")
    old = table(spark, d, "documents").select("doc_id", F.col("source").alias("value"))
    new = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("value"))
    SK.merge_into_new_version(spark, old, base, ["doc_id"])
    v = SK.merge_into_new_version(spark, new, base, ["doc_id"])
    return SK.read_latest(spark, base).withColumn("version", F.lit(v))


@query("bucket_merge", "S8", """
WITH old AS (SELECT doc_id, lang, source AS value FROM documents),
     new AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS value FROM labels)
SELECT doc_id, old.lang, coalesce(new.value, old.value) AS value, CAST(1 AS BIGINT) AS version FROM old FULL JOIN new USING (doc_id)""")
def bucket_merge(spark, d):
    """A table in hash buckets; an upsert rewrites the buckets of its keys only."""
    t = BucketTable(scratch_path(spark, "bucket-table"), ("doc_id",), 16)
    t.merge(table(spark, d, "documents").select("doc_id", "lang", F.col("source").alias("value")))
    done = t.upsert(table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("value")))
    return t.read(spark).withColumn("version", F.lit(done["version"]).cast("long"))


@query("csv_export", "S10/R6", with_posts(f"""
SELECT platform, post_id, CAST(length(text) AS BIGINT) AS text_length FROM posts_v WHERE {P2_SQL}
ORDER BY {_md5('42', 'post_id')}, post_id LIMIT 100"""))
def csv_export(spark, d):
    path = scratch_path(spark, "csv")
    pool = FL.pool_filter_strip(posts(spark, d))
    prev = SA.seeded_preview(pool, 100, "42").select("platform", "post_id",
                                                     F.length("text").cast("long").alias("text_length"))
    SK.export_csv(prev, path)
    return spark.read.schema("platform string, post_id string, text_length long").option("header", True).csv(path)


@query("json_export", "S9/A8", with_posts(f"""
SELECT CAST(count(*) AS BIGINT) AS total_samples, CAST(min(length(text)) AS BIGINT) AS min_len,
       CAST(max(length(text)) AS BIGINT) AS max_len FROM posts_v WHERE {P2_SQL}"""))
def json_export(spark, d):
    from postloom.operators import profile as PR

    path = scratch_path(spark, "json")
    prof = PR.pool_profile(FL.pool_filter_strip(posts(spark, d)), 10, 1000)
    SK.export_json(prof, path, single_file=True)
    back = spark.read.schema("total_samples long, length_stats struct<min: long, max: long>").json(path)
    return back.select("total_samples", F.col("length_stats.min").alias("min_len"),
                       F.col("length_stats.max").alias("max_len"))


@query("table_preview", "S12/L4/T17", """
SELECT doc_id, '[Array of ' || CAST(length(text) AS VARCHAR) || ' items]' AS chars,
       CAST(length(text) AS BIGINT) AS n_chars, CAST((SELECT count(*) FROM documents) AS BIGINT) AS n_rows
FROM documents ORDER BY doc_id LIMIT 5""")
def table_preview(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.split(F.col("text"), "").alias("chars"),
                                               F.length("text").cast("long").alias("n_chars"))
    # split(text, '') yields one element per character (code point)
    return SK.preview(docs, ["doc_id"], 5, array_cols=("chars",), count="n_rows")



@query("cleaned_scan", "S4/S5/F8", with_posts("""
, sr AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || platform || '|' || post_id), platform, post_id) - 1 AS rk,
                count(*) OVER () AS n FROM posts_v WHERE text IS NOT NULL),
 sp AS (SELECT *, CASE WHEN rk < n - (3 * n + 9) // 10 THEN 'train'
                       WHEN rk < n - (3 * n + 9) // 10 + (3 * n + 9) // 10 - ((3 * n + 9) // 10 + 1) // 2 THEN 'val'
                       ELSE 'test' END AS split_group FROM sr)
SELECT split_group, 0 AS label, CAST(count(*) AS BIGINT) AS n FROM sp
WHERE length(""" + S.clean('text') + """) > 0 GROUP BY split_group"""))
def cleaned_scan(spark, d):
    from postloom.operators.features import clean_track

    path = scratch_path(spark, "cleaned-posts")
    track = clean_track(spread(posts(spark, d)), ["platform", "post_id"])
    with shuffles_released(spark):
        track.write.mode("overwrite").option("compression", COMPRESSION).parquet(path)
    scanned = PL.scan_cleaned(spark, path)  # projected scan, NULL text dropped
    return scanned.groupBy("split_group", "label").agg(F.count(F.lit(1)).alias("n"))


@query("synthetic_append", "S7/P10/G11", with_posts(PLAN_SQL + """
SELECT pl.platform, CAST(2 * count(*) AS BIGINT) AS n_rows, CAST(2 * sum(length(""" + S.strip("'  ' || p.text || chr(10)") + """)) AS BIGINT) AS sum_len
FROM plan pl JOIN posts_v p ON p.post_id = CAST(pl.request_id AS VARCHAR)
WHERE pl.request_id % 11 <> 0 GROUP BY pl.platform"""))
def synthetic_append(spark, d):
    from postloom.plans.q_prompts import result_rows

    path = scratch_path(spark, "synthetic-posts")
    rows = result_rows(spark, d).drop("request_id", "output_tokens")
    rows = SK.synthetic_layout(rows.drop("text_length", "is_synthetic"))
    SK.append(rows, path)
    SK.append(rows, path)  # a second generation batch appends, never replaces
    back = spark.read.parquet(path)
    return back.groupBy("platform").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("text_length").cast("long").alias("sum_len"))


@query("recent_synthetic", "L2/S7", """
SELECT request_id, generated_at FROM (SELECT event_id AS request_id, ts AS generated_at FROM events WHERE event_type <> 'error')
ORDER BY generated_at DESC, request_id LIMIT 10""")
def recent_synthetic(spark, d):
    """The latest rows of the stored synthetic table by ``generated_at``."""
    from postloom.operators import windows as WN

    path = scratch_path(spark, "synthetic-posts")
    rows = table(spark, d, "events").where("event_type <> 'error'").select(
        F.col("event_id").alias("request_id"), F.col("event_type").alias("platform"), F.col("props").alias("text"), F.col("ts").alias("generated_at"))
    SK.append(SK.synthetic_layout(rows), path)
    return WN.most_recent(spark.read.parquet(path), 10, "generated_at", "request_id").select("request_id", "generated_at")
