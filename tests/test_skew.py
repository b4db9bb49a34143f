"""One key holding a third of all rows: results stay exact and whole, and the
plans avoid a window over the whole hot key where the design says so."""

from pyspark.sql import functions as F

from postloom.operators import features as FE
from postloom.operators import ledger as LG
from postloom.operators import sampling as SA
from postloom.operators import tables as TB
from postloom.operators import windows as WN


def _skewed(spark, n=30000):
    # platform 'hot' holds a third of the rows
    return spark.range(n).select(
        F.col("id").cast("string").alias("post_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 97).cast("string")))
        .alias("platform"),
        (F.col("id") * 7 % 1000).alias("ts_s"),
        (F.col("id") % 5).cast("double").alias("cost"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_rank_on_hot_key_is_complete(spark):
    df = _skewed(spark)
    r = SA.exact_rank(df, ["platform"], "s", ["post_id"], width=3)
    hot = r.filter(F.col("platform") == "hot").agg(F.min("rank"), F.max("rank"), F.count("*"),
                                                    F.countDistinct("rank")).first()
    assert (hot[0], hot[1], hot[2], hot[3]) == (0, 9999, 10000, 10000)
    # the row_number window is partitioned by (platform, block), never by platform alone
    assert "Window [row_number()" in _plan(r) and "__blk" in _plan(r)


def test_first_wins_sends_one_row_per_key_and_task(spark):
    df = _skewed(spark).withColumn("k", F.when(F.col("platform") == "hot", F.lit("hot")).otherwise(F.col("post_id")))
    out = TB.first_wins(df, ["k"], ["ts_s", "post_id"])
    assert out.count() == 20001
    assert out.filter(F.col("k") == "hot").first()["ts_s"] == 0
    plan = _plan(out)
    assert "row_number(), 1, Partial" in plan  # the limit stands before the exchange


def test_top_k_and_running_totals_on_hot_key(spark):
    df = _skewed(spark)
    top = WN.newest_per_key(df, ["platform"], 3, ts="ts_s", tie="post_id")
    assert top.filter(F.col("platform") == "hot").count() == 3
    assert "WindowGroupLimit" in _plan(top)
    run = LG.running_totals(df, ["platform"], ["ts_s", "post_id"], {"cum": LG.money("cost")}, rows=1000)
    last = run.filter(F.col("platform") == "hot").agg(F.max("seq"), F.max("cum")).first()
    want = df.filter(F.col("platform") == "hot").agg(F.count("*"), F.sum("cost")).first()
    assert last[0] == want[0] and float(last[1]) == want[1]


def test_blocks_of_running_totals_are_bounded(spark):
    """One hour and one run may hold all rows: blocks follow the rows, the number of ranges does not."""
    def totals(n, rows, part=True):
        df = spark.range(n).select(F.lit("run").alias("r"), F.lit(0).alias("ts"), F.col("id"), F.lit(1.0).alias("cost"))
        return LG.running_totals(df, ["r"] if part else [], ["ts", "id"], {"cum": LG.money("cost")}, rows=rows, partitions=6)

    for part in (True, False):
        out = totals(20000, 500, part)
        assert out.where((F.col("seq") != F.col("id") + 1) | (F.col("cum") != F.col("seq"))).count() == 0 and out.count() == 20000
        plan = _plan(out)
        # the rows meet in windows of one sub-block, the scans see sums only
        assert "Window [row_number()" in plan and plan.count("__block") > 0 and "SinglePartition" not in plan.split("Window [row_number()")[1][:200]
    small, large = _plan(totals(2000, 500)), _plan(totals(60000, 500))
    assert small.count("Exchange") == large.count("Exchange")


def test_running_totals_keep_null_parts_and_ties(spark):
    rows = [(None, 1, 1.0), (None, 2, 2.0), ("a", 1, 4.0), ("a", 1, 4.0), ("a", 3, 8.0), ("b", 1, None)]
    out = LG.running_totals(spark.createDataFrame(rows, "r string, t int, cost double"), ["r"], ["t"], {"cum": LG.money("cost")}, rows=2, partitions=3)
    got = sorted(((r.r, r.t, r.seq, None if r.cum is None else float(r.cum)) for r in out.collect()), key=repr)
    assert [x for x in got if x[0] is None] == [(None, 1, 1, 1.0), (None, 2, 2, 3.0)]
    assert sorted(x[2:] for x in got if x[0] == "a") == [(1, 4.0), (2, 8.0), (3, 16.0)]
    assert [x[:3] for x in got if x[0] == "b"] == [("b", 1, 1)]


def test_hot_bigram_and_word(spark):
    """One bigram is a third of all tokens and more: same values as brute force, and no token lost."""
    import math
    from collections import Counter

    texts = {i: ("of the " * (200 + i) + f"w{i} w{i + 1}").strip() for i in range(30)} | {100: "", 101: "one", 102: None}
    df = spark.createDataFrame(list(texts.items()), "k int, text string")
    toks = {k: (t or "").split() for k, t in texts.items()}
    uni = Counter(w for t in toks.values() for w in t)
    bi = Counter(p for t in toks.values() for p in zip(t, t[1:], strict=False))
    want = {k: math.exp(sum(-math.log((bi[p] + 1) / (uni[p[0]] + len(uni))) for p in zip(t, t[1:], strict=False)) / (len(t) - 1)) if len(t) > 1 else 0.0 for k, t in toks.items()}
    got = {r.k: r.perplexity for r in FE.bigram_perplexity(df, "k").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    seqs = FE.token_ids(df, "k", "text", max_len=12).collect()
    vocab = {}
    for k, t in toks.items():
        mine = sorted((r.seq_no, r.input_ids) for r in seqs if r.k == k)
        assert [s for s, _ in mine] == list(range(max(1, -(-len(t) // 10)))) and all(x[0] == FE.CLS and x[-1] == FE.SEP and len(x) <= 12 for _, x in mine)
        for w, i in zip(t, [i for _, x in mine for i in x[1:-1]], strict=True):
            assert vocab.setdefault(w, i) == i
    assert sorted(vocab.values()) == list(range(FE.FIRST_WORD_ID, FE.FIRST_WORD_ID + len(uni)))
