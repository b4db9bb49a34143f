"""The key store and the stream's state: what a batch costs does not follow the history."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from postloom.session import exists, scratch_path
from postloom.sources import keystore as KS
from postloom.sources import manifest as MF
from postloom.streaming import ingest as IN
from postloom.streaming.ingest import Store, cursors, ingest_once, run_ingest, run_log

AS_OF = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)


def clock():
    return AS_OF


def _keys(spark, numbers):
    return spark.createDataFrame([(str(n),) for n in numbers], "post_id string")


def test_existence_check_does_not_shuffle_the_store(spark):
    store = KS.KeyStore(scratch_path(spark, "t-keys"), buckets=8)
    store.add(_keys(spark, range(100)), "a")
    store.add(_keys(spark, range(100, 150)), "b")
    store.add(_keys(spark, range(200, 210)), "dead")
    live = [["a", 0], ["b", 0]]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        incoming = _keys(spark, range(90, 260))
        found = store.stored(incoming, live)
        assert {int(r.post_id) for r in found.collect()} == set(range(90, 150))
        plan = incoming.join(store.keys(spark, live), "post_id", "left_anti")
        assert {int(r.post_id) for r in plan.collect()} == set(range(150, 260))
        text = incoming.join(store.keys(spark, live), "post_id", "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in text and text.count("Exchange hashpartitioning") == 1  # the incoming side only
        assert "PartitionFilters" in text and "seg" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert store.stored(incoming, []).count() == 0


def test_a_segment_of_the_same_name_is_replaced(spark):
    store = KS.KeyStore(scratch_path(spark, "t-replace"), buckets=4)
    store.add(_keys(spark, [1, 2]), "a")
    store.add(_keys(spark, [2, 3]), "a")
    assert sorted(r.post_id for r in store.keys(spark, [["a", 0]]).collect()) == ["2", "3"]
    store.add(_keys(spark, []), "a")
    assert store.keys(spark, [["a", 0]]).count() == 0


def test_segments_grow_with_the_logarithm(spark, monkeypatch):
    monkeypatch.setattr(KS, "FAN", 3)
    store, live, all_keys = KS.KeyStore(scratch_path(spark, "t-compact"), buckets=2), [], set()
    for k in range(14):
        live, gone = store.compact(spark, live)
        store.drop(spark, gone)
        assert not any(exists(spark, f"{store.path}/seg={s}") for s in gone)
        store.add(_keys(spark, [k, k + 100]), f"s{k}")
        live.append([f"s{k}", 0])
        all_keys |= {str(k), str(k + 100)}
        assert len(live) <= 3 * 3
        assert sorted(r.post_id for r in store.keys(spark, live).collect()) == sorted(all_keys)
    assert max(c for _, c in live) == 2


def test_manifest_publishes_whole_versions(spark):
    folder = scratch_path(spark, "t-manifest")
    assert MF.read(spark, folder) == (-1, {})
    for v in range(5):
        MF.publish(spark, folder, v, {"n": v})
    assert MF.read(spark, folder) == (4, {"n": 4}) and MF.versions(spark, folder) == [2, 3, 4]
    with pytest.raises(FileExistsError):
        MF.publish(spark, folder, 4, {"n": "other"})
    assert MF.read(spark, folder) == (4, {"n": 4})


def tweet(i, day):
    return {"id_str": str(i), "text": f"t{i}", "created_at": f"2024-01-{day:02d}T00:00:00Z"}


def bsky(i, day):
    return {"uri": f"at://x/app.bsky.feed.post/{i}", "record": {"text": "t", "created_at": f"2024-01-{day:02d}T00:00:00Z"}}


def _drop(spark, path, posts):
    spark.createDataFrame([(json.dumps(p),) for p in posts], "value string").coalesce(1).write.mode("append").text(path)


def test_state_goes_on_after_a_restart_and_late_posts_are_skipped(spark):
    root = scratch_path(spark, "t-state")
    store, base = Store(f"{root}/store", 2), f"{root}/landing/bluesky"
    landing = {"bluesky": base}
    _drop(spark, f"{base}/query=a", [bsky("p1", 5), bsky("p2", 9)])
    _drop(spark, base, [bsky("q1", 3)])  # without a query
    run_ingest(spark, landing, store, f"{root}/ckpt", clock)
    # one file a batch: p4 lies before p3, but both came with one poll
    _drop(spark, f"{base}/query=a", [bsky("p3", 12)])
    _drop(spark, f"{base}/query=a", [bsky("p4", 11), bsky("late", 7)])
    _drop(spark, base, [bsky("q2", 3), bsky("q3", 4)])
    run_ingest(spark, landing, store, f"{root}/ckpt", clock, max_files=1)
    got = {r.post_id for r in store.read(spark, "posts").collect()}
    assert got == {"p1", "p2", "p3", "p4", "q1", "q3"}
    assert {r.query: (r.last_post_id, r.last_timestamp.day) for r in cursors(spark, store).collect()} == {"a": ("p3", 12), "": ("q3", 4)}
    log = run_log(spark, store).groupBy("query").agg(F.sum("offered"), F.sum("skipped"), F.sum("saved")).collect()
    assert sorted(tuple(r) for r in log if r[0]) == [("a", 5, 1, 4)]
    # the counters are in the stream's state
    state = spark.read.format("statestore").load(f"{root}/ckpt/bluesky").select("key.*", "value.*")
    rows = [r.asDict(recursive=True) for r in state.collect()]
    assert sorted((r["query"] or "", (r.get("groupState") or r)["offered"], (r.get("groupState") or r)["batches"]) for r in rows) == [("", 3, 2), ("a", 5, 3)]
    # a new checkpoint starts from the published cursors
    _drop(spark, f"{base}/query=a", [bsky("later", 8), bsky("p9", 20)])
    run_ingest(spark, {"bluesky": base}, store, f"{root}/ckpt-b", clock)
    assert {r.post_id for r in store.read(spark, "posts").collect()} == got | {"p9"}


def test_a_crash_between_commit_and_publish_loses_and_doubles_nothing(spark, monkeypatch):
    root = scratch_path(spark, "t-crash")
    store, landing = Store(f"{root}/store", 2), {"twitter": f"{root}/landing/twitter"}
    _drop(spark, landing["twitter"], [tweet(i, 1 + i) for i in range(4)])
    run_ingest(spark, landing, store, f"{root}/ckpt", clock)
    _drop(spark, landing["twitter"], [tweet(i, 1 + i) for i in range(2, 8)])
    real = MF.publish

    def crash(spark, folder, version, document):
        if "segments" in document:
            raise RuntimeError("power cut")
        return real(spark, folder, version, document)

    monkeypatch.setattr(IN.MF, "publish", crash)
    with pytest.raises(Exception, match="power cut"):
        run_ingest(spark, landing, store, f"{root}/ckpt", clock)
    monkeypatch.setattr(IN.MF, "publish", real)
    # the run is still open: it goes on with its floors, and the batch replaces itself
    run_ingest(spark, landing, store, f"{root}/ckpt", clock)
    ids = sorted(int(r.post_id) for r in store.read(spark, "posts").collect())
    assert ids == list(range(8))
    assert [(r.last_post_id, r.query) for r in cursors(spark, store).collect()] == [("7", "")]
    _drop(spark, landing["twitter"], [tweet(3, 30), tweet(9, 30)])
    run_ingest(spark, landing, store, f"{root}/ckpt", clock, incremental=False)
    assert store.read(spark, "posts").count() == 9


def test_an_old_run_may_be_done_again_after_its_keys_were_merged(spark, monkeypatch):
    monkeypatch.setattr(KS, "FAN", 2)
    root = scratch_path(spark, "t-again")
    store = Store(f"{root}/store", 2)
    for k in range(5):
        _drop(spark, f"{root}/l{k}", [tweet(10 * k + i, 1) for i in range(3)])
        ingest_once(spark, {"twitter": f"{root}/l{k}"}, store, run=f"r{k}", clock=clock, incremental=False)
    ingest_once(spark, {"twitter": f"{root}/l0"}, store, run="r0", clock=clock, incremental=False)
    assert sorted(int(r.post_id) for r in store.read(spark, "posts").collect()) == sorted(10 * k + i for k in range(5) for i in range(3))
    _, manifest = store.progress(spark, "twitter")
    assert len(manifest["segments"]) <= 4


def test_a_batch_lists_no_history(spark, monkeypatch):
    """Folders that hold one entry per past batch are not listed by a batch."""
    root = scratch_path(spark, "t-flat")
    store = Store(f"{root}/store", 2)
    listed, real = [], IN.sub_folders
    monkeypatch.setattr(IN, "sub_folders", lambda s, path: listed.append(path) or real(s, path))
    for k in range(3):
        _drop(spark, f"{root}/l{k}", [tweet(k, 1 + k)])
        ingest_once(spark, {"twitter": f"{root}/l{k}"}, store, clock=clock)
    assert set(listed) == {f"{store.root}/progress"}
    assert len(MF.versions(spark, f"{store.root}/progress/twitter")) == 3


def test_the_sample_of_all_batches_equals_that_of_the_pool(spark):
    from postloom.operators import filters as FL
    from postloom.operators import sampling as SA
    from postloom.streaming.ingest import SAMPLE_SEED

    root = scratch_path(spark, "t-sample")
    store = Store(f"{root}/store", 2, sample=5)
    for k in range(3):
        posts = [tweet(100 * k + i, 1) | {"text": "long enough text" if i % 3 else "short"} for i in range(12)]
        _drop(spark, f"{root}/l{k}", posts + [tweet(3, 1) | {"text": "long enough text"}])
        ingest_once(spark, {"twitter": f"{root}/l{k}"}, store, run=f"r{k}", clock=clock, incremental=False)
    ingest_once(spark, {"twitter": f"{root}/l1"}, store, run="r1", clock=clock, incremental=False)  # done again
    pool = FL.pool_filter_sql(store.read(spark, "posts"))
    want = {r.post_id for r in SA.random_k(pool, 5, SAMPLE_SEED).collect()}
    got = [r.post_id for r in store.sampled(spark, "twitter").collect()]
    assert len(got) == 5 and set(got) == want
