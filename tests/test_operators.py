"""Operator semantics and invariants on small hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postloom import config
from postloom.operators import ledger as LG
from postloom.operators import normalize as NZ
from postloom.operators import prompts as PM
from postloom.operators import sampling as SA
from postloom.operators import tables as TB
from postloom.sources import payloads as PL

INGEST = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)


def test_quotas_match_fixture():
    short = [config.bucket_quotas(n)[0] for n in range(8, 16)]
    medium = [config.bucket_quotas(n)[1] for n in range(8, 16)]
    assert short == [2, 2, 3, 3, 3, 3, 4, 4]
    assert medium == [3, 3, 4, 4, 4, 5, 5, 6]


@pytest.mark.parametrize("n,sizes", [(1000, (700, 150, 150)), (1001, (700, 150, 151)), (10, (7, 1, 2))])
def test_split_sizes_exact(spark, n, sizes):
    df = spark.range(n).withColumnRenamed("id", "k")
    s = SA.split_exact(df, ["k"], "42", width=2)
    got = {r.split_group: r["count"] for r in s.groupBy("split_group").count().collect()}
    assert (got.get("train", 0), got.get("val", 0), got.get("test", 0)) == sizes
    assert s.select("k").distinct().count() == n


def test_exact_rank_is_a_permutation(spark):
    df = spark.range(5000).withColumn("p", F.col("id") % 3)
    r = SA.exact_rank(df, ["p"], "s", ["id"], width=2)
    per = r.groupBy("p").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count("*").alias("n"),
                             F.countDistinct("rank").alias("d")).collect()
    for row in per:
        assert row.lo == 0 and row.hi == row.n - 1 and row.d == row.n


def test_first_wins_and_idempotent_ingest(spark):
    batch = spark.createDataFrame([("reddit", "a", 1, "first"), ("reddit", "a", 2, "second"), ("bluesky", "a", 3, "x")],
                                  "platform string, post_id string, arrival int, v string")
    first = TB.first_wins(batch, ["platform", "post_id"], ["arrival"])
    got = {(r.platform, r.post_id): r.v for r in first.collect()}
    assert got == {("reddit", "a"): "first", ("bluesky", "a"): "x"}
    stored = first
    again = TB.new_only(first, stored, ["platform", "post_id"])
    assert again.count() == 0


def test_upsert_overwrites_supplied_columns(spark):
    stored = spark.createDataFrame([("p", "1", 5, 7, "t1")], "platform string, post_id string, a long, b long, text string")
    upd = spark.createDataFrame([("p", "1", None, 9), ("p", "2", 1, 1)], "platform string, post_id string, a long, b long")
    out = {r.post_id: r for r in TB.upsert(stored, upd, ["platform", "post_id"]).collect()}
    assert (out["1"].a, out["1"].b, out["1"].text) == (None, 9, "t1")
    assert (out["2"].a, out["2"].b, out["2"].text) == (1, 1, None)


def test_cursor_merge_keeps_old_on_empty(spark):
    old = spark.createDataFrame([("t", "q", "10", "c1")], "platform string, query string, last_post_id string, cursor string")
    new = spark.createDataFrame([("t", "q", "", "c2"), ("r", "q", "5", "")],
                                "platform string, query string, last_post_id string, cursor string")
    out = {r.platform: r for r in TB.cursor_merge(old, new, ["platform", "query"], ["last_post_id", "cursor"],
                                                  dt.datetime(2026, 1, 1)).collect()}
    assert (out["t"].last_post_id, out["t"].cursor) == ("10", "c2")
    assert (out["r"].last_post_id, out["r"].cursor) == ("5", None)


def test_parse_prompt(spark):
    df = spark.createDataFrame([("System: a User: b User: c",), ("User: b",), ("System: x",)], "p string")
    got = [[(m.role, m.content) for m in r[0]] for r in df.select(PM.parse_prompt(F.col("p"))).collect()]
    assert got[0] == [("system", "a"), ("user", "b User: c")]
    assert got[1] == [("user", "User: b")]
    assert got[2] == [("user", "System: x")]


def test_cost_and_default_price(spark):
    led = spark.createDataFrame([("claude", "realtime", 1_000_000, 1_000_000), ("nope", "realtime", 1_000_000, 0)],
                                "price_model string, mode string, input_tokens long, output_tokens long")
    p = LG.with_prices(led, spark, "price_model", mode_col="mode")
    c = {r.price_model: r.c for r in p.select("price_model", LG.cost(F.col("input_tokens"), F.col("output_tokens"),
                                                                      F.col("input_per_m"), F.col("output_per_m")).alias("c")).collect()}
    assert c == {"claude": pytest.approx(18.0), "nope": pytest.approx(config.DEFAULT_PRICE[0])}


def test_running_totals_monotone_and_exact(spark):
    rows = [(i % 3, i, float(i % 7) / 10) for i in range(600)]
    df = spark.createDataFrame(rows, "run int, seq0 int, cost double")
    r = LG.running_totals(df, ["run"], ["seq0"], {"cum": LG.money("cost")}, rows=50)
    got = sorted((x.run, x.seq, float(x.cum)) for x in r.collect())
    for run in range(3):
        mine = [g for g in got if g[0] == run]
        exp, acc = [], 0.0
        for i, (_, s0, c) in enumerate(sorted((a, b, c) for a, b, c in rows if a == run)):
            acc += c
            exp.append((run, i + 1, round(acc, 6)))
        assert [(a, b, round(c, 6)) for a, b, c in mine] == exp


def _json_df(spark, rows):
    import json
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")


def test_twitter_normalize_edges(spark):
    rows = [
        {"id": 1, "id_str": "", "text": "", "full_text": "hello #X", "created_at": "2026-04-08T19:50:36.273206Z",
         "public_metrics": {"like_count": 0}, "favorite_count": 5, "referenced_tweets": [], "entities": None},
        {"id": 2, "text": "t", "created_at": "garbage", "referenced_tweets": [{"type": "retweeted", "id": "9"}]},
        {"id": 3, "text": "t", "created_at": "", "in_reply_to_status_id": "1"},
        {"id_str": "", "text": "no id"},
    ]
    raw = PL.parse_payloads(_json_df(spark, rows), "twitter")
    out = NZ.normalize_twitter(raw, INGEST).orderBy("post_id").collect()
    by = {r.post_id: r for r in out}
    assert by["1"].text == "hello #X" and by["1"].like_count == 5 and by["1"].is_repost is False
    assert by["1"].has_media is False and by["1"].language == "unknown" and by["1"].hashtags == ["X"]
    assert by["1"].created_at_imputed is False
    assert by["2"].is_repost is True and by["2"].created_at_imputed is True
    assert by["3"].is_reply is True and by["3"].created_at_imputed is True
    assert [r.reject_reason for r in out if r.post_id is None] == ["missing id"]


def test_reddit_and_bluesky_normalize_edges(spark):
    red = PL.parse_payloads(_json_df(spark, [{"id": "r1", "title": "T", "selftext": "", "author": None,
                                              "is_self": True, "created_utc": 0.0}]), "reddit")
    r = NZ.normalize_reddit(red, INGEST).first()
    assert (r.text, r.author_username, r.author_followers, r.has_media) == ("T", "[deleted]", 0, False)
    blu = PL.parse_payloads(_json_df(spark, [{"uri": "", "record": {"text": "x"}},
                                             {"uri": "at://d/app.bsky.feed.post/abc", "record": {"text": "y", "langs": []},
                                              "reason": {"py_type": "app.bsky.feed.defs#reasonRepost"}}]), "bluesky")
    ok, bad = NZ.split_rejects(NZ.normalize_bluesky(blu, INGEST))
    assert bad.count() == 1
    row = ok.first()
    assert (row.post_id, row.is_repost, row.language) == ("abc", True, "unknown")


def test_request_examples_without_replacement(spark):
    posts = spark.createDataFrame([(str(i), "reddit", "x" * (10 + (i * 37) % 900), False) for i in range(300)],
                                  "post_id string, platform string, text string, has_media boolean")
    req = spark.createDataFrame([(i, "reddit", 8 + i % 8) for i in range(50)], "request_id long, platform string, n_examples int")
    ex = SA.request_examples(req, posts, "7", width=2)
    per = ex.groupBy("request_id").agg(F.count("*").alias("n"), F.countDistinct("post_id").alias("d")).collect()
    assert all(r.n == r.d for r in per)
    want = {i: 8 + i % 8 for i in range(50)}
    assert all(r.n == want[r.request_id] for r in per)


def test_requests_get_all_examples_that_the_pool_has(spark):
    """Any platform of the table is chosen; short buckets are filled up from the pool, without repeats."""
    posts = spark.createDataFrame([("threads" if i % 2 else "bluesky", str(i), "x" * (5 + i % 9 if i < 40 else 4000), False) for i in range(60)],
                                  "platform string, post_id string, text string, has_media boolean")
    counts = posts.groupBy("platform").count().withColumnRenamed("count", "n")
    req = SA.choose_platform(spark.range(300).withColumnRenamed("id", "request_id"), counts, "3")
    assert {r.platform for r in req.select("platform").distinct().collect()} == {"threads", "bluesky"}
    req = req.withColumn("n_examples", (F.col("request_id") % 40).cast("int"))
    got = SA.request_examples(req, posts, "3").groupBy("request_id").agg(F.count("*").alias("n"), F.countDistinct("post_id").alias("d")).collect()
    pool = {r.platform: r.n for r in counts.collect()}
    want = {r.request_id: min(r.n_examples, pool[r.platform]) for r in req.collect()}
    assert {r.request_id: r.n for r in got} == {k: v for k, v in want.items() if v} and all(r.n == r.d for r in got)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 7, 20])
def test_split_of_few_rows(spark, n):
    s = SA.split_exact(spark.range(n).withColumnRenamed("id", "k"), ["k"], "42")
    rest = -(-3 * n // 10)
    want = {"train": n - rest, "val": rest - (rest + 1) // 2, "test": (rest + 1) // 2}
    assert {r.split_group: r["count"] for r in s.groupBy("split_group").count().collect()} == {k: v for k, v in want.items() if v}


def test_last_of_repeated_keys_counts(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 2), (2, "y", 1), (3, "p", 5), (3, "q", 7)], "k int, v string, at int")
    for out in (TB.upsert(stored, new, ["k"], ["at"]), TB.latest_wins(stored, new, ["k"], ["at"]), TB.writeback(stored.union(spark.createDataFrame([(3, "c")], "k int, v string")), new, ["k"], ["v"], ["at"])):
        assert sorted(tuple(r) for r in out.select("k", "v").collect()) == [(1, "a"), (2, "x"), (3, "q")]
    flags = TB.with_inserted_flag(new, stored, ["k"], ["at"]).collect()
    assert sorted((r.k, r.at, r.inserted) for r in flags) == [(2, 1, False), (2, 2, False), (3, 5, True), (3, 7, False)]


def test_scratch_is_released(spark):
    from postloom.session import exists, materialize, release_scratch

    df = materialize(spark.range(3), "t-release")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert exists(spark, path) and release_scratch(spark) > 0 and not exists(spark, path)
