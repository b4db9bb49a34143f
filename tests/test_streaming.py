"""Ingest invariants: batch run = streaming run; re-delivery adds nothing; a fresh checkpoint, a
failing read and a half-written version lose nothing; template file read by Spark (BOM)."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from postloom.operators import tables as TB
from postloom.plans.q_normalize import bluesky_payloads, reddit_payloads, twitter_payloads
from postloom.session import scratch_path
from postloom.sources import payloads as PL
from postloom.sources import sinks as SK
from postloom.sources import templates as TP
from postloom.sources.schemas import SCRAPER_STATE
from postloom.streaming.ingest import Store, cursors, ingest_once, run_ingest, run_log, sifted, with_progress
from tests.conftest import SF001

AS_OF = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)


def clock():
    return AS_OF


def _landing(spark, root, platforms=("twitter", "reddit", "bluesky")):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    build = {"twitter": twitter_payloads, "reddit": reddit_payloads, "bluesky": bluesky_payloads}
    out = {}
    for name in platforms:
        path = f"{root}/landing/{name}"
        build[name](spark, SF001, docs).select("raw_json").write.mode("overwrite").text(path)
        out[name] = path
    return out


def _drop(spark, path, lines):
    spark.createDataFrame([(json.dumps(x) if isinstance(x, dict) else x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


def _keys(spark, store):
    return {tuple(r) for r in store.read(spark, "posts").select("platform", "post_id").collect()}


def tweet(i, **more):
    return {"id_str": str(i), "text": f"t{i}", "created_at": f"2024-01-{1 + i % 27:02d}T00:00:00Z", **more}


def test_batch_equals_stream_and_redelivery_is_idempotent(spark):
    root = scratch_path(spark, "t-stream")
    landing = _landing(spark, root)
    s_store, b_store = Store(f"{root}/s", 8), Store(f"{root}/b", 8)
    run_ingest(spark, landing, s_store, f"{root}/ckpt", clock)
    run = ingest_once(spark, landing, b_store, clock=clock)
    s, b = _keys(spark, s_store), _keys(spark, b_store)
    assert s == b and len(s) > 0
    # the same files again as a new run, with and without the incremental filter: nothing new is stored
    for incremental in (True, False):
        ingest_once(spark, landing, b_store, clock=clock, incremental=incremental)
        assert b_store.read(spark, "posts").count() == len(b)
    # a retried run replaces its own output instead of doubling it
    ingest_once(spark, landing, b_store, run=run, clock=clock)
    assert _keys(spark, b_store) == b and b_store.read(spark, "posts").count() == len(b)
    tags = b_store.read(spark, "post_hashtags")
    assert tags.groupBy("platform", "post_id", "hashtag").count().filter("count > 1").count() == 0


def test_a_fresh_checkpoint_keeps_the_store(spark):
    root = scratch_path(spark, "t-fresh")
    store, landing = Store(f"{root}/store", 8), {"twitter": f"{root}/landing/twitter"}
    _drop(spark, landing["twitter"], [tweet(i) for i in range(3)])
    run_ingest(spark, landing, store, f"{root}/ckpt-a", clock)
    _drop(spark, landing["twitter"], [tweet(i) for i in (10, 11)])
    run_ingest(spark, landing, store, f"{root}/ckpt-b", clock)
    assert {k for _, k in _keys(spark, store)} == {"0", "1", "2", "10", "11"}
    assert store.read(spark, "posts").count() == 5


def test_no_post_is_lost_to_a_wrong_clock_and_rejects_are_kept(spark):
    root = scratch_path(spark, "t-future")
    store, landing = Store(f"{root}/store", 8), {"twitter": f"{root}/landing/twitter"}
    _drop(spark, landing["twitter"], [tweet(1) | {"created_at": "2099-01-01T00:00:00Z"}])
    run_ingest(spark, landing, store, f"{root}/ckpt", clock, incremental=False)
    _drop(spark, landing["twitter"], [tweet(i) for i in range(2, 6)] + ['{"id_str": "9", "te', "[1]", {"text": "no id"}, {"text": "no id 2"}, {"text": "no id 2"}])
    run_ingest(spark, landing, store, f"{root}/ckpt", clock, incremental=False)
    assert {k for _, k in _keys(spark, store)} == {"1", "2", "3", "4", "5"}
    bad = sorted((r.reject_reason, r.raw_json) for r in store.read(spark, "rejects").collect())
    assert bad == sorted([("malformed payload", '{"id_str": "9", "te'), ("malformed payload", "[1]"), ("missing id", '{"text": "no id"}')] + [("missing id", '{"text": "no id 2"}')] * 2)


def test_unknown_keys_stay_in_the_payload(spark):
    root = scratch_path(spark, "t-raw")
    store, landing = Store(f"{root}/store", 8), {"twitter": f"{root}/landing/twitter"}
    line = '{"id_str": "5",  "text": "x", "geo": {"lat": 1.50}, "source": "web"}'
    _drop(spark, landing["twitter"], [line])
    ingest_once(spark, landing, store, clock=clock)
    assert [r.raw_json for r in store.read(spark, "posts").collect()] == [line]


def test_incremental_filter_and_cursor_per_query(spark):
    root = scratch_path(spark, "t-cursor")
    store, base = Store(f"{root}/store", 8), f"{root}/landing/bluesky"
    post = lambda i, day: {"uri": f"at://x/app.bsky.feed.post/{i}", "record": {"text": "t", "created_at": f"2024-01-{day:02d}T00:00:00Z"}}
    _drop(spark, f"{base}/query=a%20b", [post("p1", 5), post("p2", 9)])
    _drop(spark, f"{base}/query=c", [post("p3", 3)])
    ingest_once(spark, {"bluesky": base}, store, clock=clock)
    got = {r.query: (r.last_post_id, str(r.last_timestamp)[:10]) for r in cursors(spark, store).collect()}
    assert got == {"a b": ("p2", "2024-01-09"), "c": ("p3", "2024-01-03")}
    later = f"{root}/later/bluesky"
    _drop(spark, f"{later}/query=a%20b", [post("p4", 7), post("p5", 10)])  # p4 lies before that query's cursor
    _drop(spark, f"{later}/query=c", [post("p6", 4)])
    ingest_once(spark, {"bluesky": later}, store, clock=lambda: AS_OF + dt.timedelta(days=1))
    assert {k for _, k in _keys(spark, store)} == {"p1", "p2", "p3", "p5", "p6"}
    log = {(r.query, r.started_at.day): (r.offered, r.skipped, r.saved) for r in run_log(spark, store).collect()}
    assert log == {("a b", 1): (2, 0, 2), ("c", 1): (1, 0, 1), ("a b", 2): (2, 1, 1), ("c", 2): (1, 0, 1)}
    got = {r.query: (r.last_post_id, r.updated_at.day) for r in cursors(spark, store).collect()}
    assert got == {"a b": ("p5", 2), "c": ("p6", 2)}


def test_a_failed_batch_is_logged_and_not_read(spark, monkeypatch):
    root = scratch_path(spark, "t-fail")
    store, landing = Store(f"{root}/store", 8), _landing(spark, root, ("bluesky",))
    real = TB.hashtag_rows

    def broken(*a, **k):
        raise RuntimeError("the disk is full")

    monkeypatch.setattr(TB, "hashtag_rows", broken)  # after the posts are written
    with pytest.raises(RuntimeError):
        ingest_once(spark, landing, store, run="r1", clock=clock)
    assert store.read(spark, "posts") is None
    failed = run_log(spark, store).collect()
    assert [(r.status, r.error, r.platform) for r in failed] == [("failed", "RuntimeError: the disk is full", "bluesky")] and failed[0].elapsed_s > 0
    monkeypatch.setattr(TB, "hashtag_rows", real)
    ingest_once(spark, landing, store, run="r1", clock=clock)
    assert store.read(spark, "posts").count() > 0
    assert {r.status for r in run_log(spark, store).collect()} == {"ok", "failed"}


def test_a_failing_read_is_not_an_empty_store(spark, monkeypatch):
    from postloom.sources import sinks

    root = scratch_path(spark, "t-read")
    store, landing = Store(f"{root}/store", 8), _landing(spark, root, ("reddit",))
    ingest_once(spark, landing, store, clock=clock)
    before = store.read(spark, "posts").count()

    def refuse(*a):
        raise PermissionError("denied")

    import postloom.streaming.ingest as ingest

    monkeypatch.setattr(ingest, "sub_folders", refuse)
    monkeypatch.setattr(sinks, "sub_folders", refuse)
    with pytest.raises(PermissionError):
        ingest_once(spark, landing, store, clock=clock)
    with pytest.raises(PermissionError):
        SK.merge_into_new_version(spark, spark.range(3), f"{root}/versions", ["id"])
    monkeypatch.undo()
    assert store.read(spark, "posts").count() == before


def test_versioned_merge_keeps_history(spark):
    base = scratch_path(spark, "t-versions")
    a = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, at int")
    b = spark.createDataFrame([(2, "B", 1), (3, "C", 2), (3, "D", 1)], "k int, v string, at int")
    assert SK.read_latest(spark, base) is None
    assert SK.merge_into_new_version(spark, a, base, ["k"], ["at"]) == 0
    # a version without its marker does not count, and the next merge replaces it
    spark.createDataFrame([(9, "half")], "k int, v string").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{base}/v=1")
    assert SK.latest_version(spark, base) == 0
    assert SK.merge_into_new_version(spark, b, base, ["k"], ["at"]) == 1
    latest = {r.k: r.v for r in SK.read_latest(spark, base).collect()}
    assert latest == {1: "a", 2: "B", 3: "C"}
    assert spark.read.parquet(f"{base}/v=0").count() == 2


def test_template_file_read_by_spark_with_bom(spark):
    df = TP.read_templates(spark, TP.DEFAULT_TEMPLATES)
    rows = {r.platform: r for r in df.collect()}
    assert set(rows) == {"reddit", "bluesky"}
    assert rows["reddit"].num_examples == 12 and rows["reddit"].system_prompt
    assert {r[0] for r in TP.load_template_rows()} == set(rows)


def test_template_export_document(spark):
    import __spark_entry__ as E

    doc = json.loads(E.queries()["template_export"](spark, SF001).first()["value"])
    assert doc["metadata"]["samples_per_prompt"] == 12
    assert sorted(doc["metadata"]["platforms"]) == sorted(doc["templates"]) == ["bluesky", "reddit"]
    t = doc["templates"]["reddit"]
    assert t["platform"] == "reddit" and t["system_prompt"] and "Example 1:" in t["user_prompt_template"]
    assert 1 <= t["num_examples"] <= 12


def test_polling_uses_each_platforms_interval(spark):
    root = scratch_path(spark, "t-poll")
    store, landing = Store(f"{root}/store", 8), _landing(spark, root, ("reddit", "bluesky"))
    ticks = []

    def tick():
        ticks.append(dt.datetime.now(dt.UTC))
        return ticks[-1]

    queries = run_ingest(spark, landing, store, f"{root}/ckpt", tick, available_now=False, intervals={"reddit": 60, "bluesky": 60})
    try:
        for _ in range(120):  # the first trigger fires at once, the next in an hour
            if len(store.committed(spark)) == 2:
                break
            time.sleep(0.5)
        assert set(queries) == {"reddit", "bluesky"} and len(ticks) == 2
        assert {r.platform for r in store.read(spark, "posts").select("platform").distinct().collect()} == {"reddit", "bluesky"}
        stamps = {r[0] for r in store.read(spark, "posts").select(F.unix_micros("scraped_at")).distinct().collect()}
        assert len(stamps) == 2  # the time of each batch, not of the start
    finally:
        for q in queries.values():
            q.stop()


def test_a_batch_writes_a_file_per_day_not_per_day_and_task(spark):
    root = scratch_path(spark, "t-days")
    store, landing = Store(f"{root}/store", 8), {"twitter": f"{root}/landing/twitter"}
    _drop(spark, landing["twitter"], [tweet(i) for i in range(540)] + [tweet(i) | {"created_at": ""} for i in range(1000, 1300)])
    ingest_once(spark, landing, store, clock=clock)
    posts = store.read(spark, "posts")
    assert posts.count() == 840
    files = posts.select("created_on", F.input_file_name().alias("file")).distinct()
    per_day = {r.created_on: r["count"] for r in files.groupBy("created_on").count().collect()}
    assert len(per_day) == 28 and sum(per_day.values()) <= 28 + 8  # 27 days and the imputed ones, 8 tasks
    assert per_day["imputed"] > 1  # a large day is cut, so it makes no large task


def test_a_scan_of_one_row_group_is_dealt_out(spark):
    from postloom.plans.registry import spread

    path = scratch_path(spark, "t-spread")
    spark.range(4000).selectExpr("id", "repeat(md5(cast(id as string)), 30) AS text").coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        scan = spark.read.parquet(path)
        held = lambda df: sum(n > 0 for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())
        assert scan.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism and held(scan) == 1
        assert held(spread(scan)) > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_stream_carries_counts_and_file_names_not_lines(spark):
    root = scratch_path(spark, "t-names")
    path, odd = f"{root}/landing/twitter", "a/b {x} [1] é 50%*?"
    rows = [(json.dumps(tweet(i)), odd if i % 2 else "en") for i in range(1, 9)] + [("{broken", odd)]
    spark.createDataFrame(rows, "value string, query string").repartition(3).write.partitionBy("query").text(path)
    seeds = spark.createDataFrame([], SCRAPER_STATE)
    plan = with_progress(PL.stream_lines(spark, path), "twitter", seeds, "p")
    assert "value" not in plan.columns and "files" in plan.columns
    store = Store(f"{root}/s", 8)
    run_ingest(spark, {"twitter": path}, store, f"{root}/ckpt", clock)
    assert _keys(spark, store) == {("twitter", str(i)) for i in range(1, 9)}
    log = run_log(spark, store).groupBy("query").agg(F.sum("offered").alias("n"), F.sum("rejected").alias("bad")).collect()
    assert {tuple(r) for r in log} == {(odd, 5, 1), ("en", 4, 0)}


def test_a_line_that_is_only_counted_leaves_its_text_behind(spark):
    path = f"{scratch_path(spark, 't-sift')}/landing"
    _drop(spark, path, [tweet(1), tweet(2), tweet(3), "{broken"])
    floors = spark.createDataFrame([("twitter", None, "2", None, None, None)], SCRAPER_STATE).withColumn("query", F.lit(""))
    got = {r.post_id: (r.fresh, r.text, r.raw_json is not None) for r in sifted(PL.read_lines(spark, path), "twitter", AS_OF, floors).collect()}
    assert got == {"1": (False, None, False), "2": (False, None, False), "3": (True, "t3", True), None: (False, "", True)}
