"""What the steps of a query leave on the disk: packed blocks, no pieces that are answered, no shuffle files of stored steps."""

import random

from pyspark.sql import functions as F

from postloom.operators import features as FE
from postloom.operators import language_model as LM
from postloom.operators import lexicon as LX
from postloom.session import ensure_checkpoint_dir, file_system, hadoop_path, materialize, scratch_path

TEXTS, WORDS = 400, 300


def _bytes(spark, path):
    return file_system(spark, path).getContentSummary(hadoop_path(spark, path)).getLength()


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def _texts(spark):
    """Words of a long-tailed vocabulary: most pairs of a block are there once."""
    rng = random.Random(3)
    word = lambda: f"word{int(rng.paretovariate(0.2)) % 20000}"
    rows = [(i, " ".join(word() for _ in range(WORDS))) for i in range(TEXTS)]
    return spark.createDataFrame(rows, "k int, text string").repartition(2), sum(len(t) for _, t in rows)


def test_a_stored_step_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    stored = materialize(spark.range(1000).repartition(4, "id").groupBy("id").count(), "t-released")
    assert _shuffle_files(spark) == before and stored.count() == 1000


def test_stored_texts_are_packed_densely(spark):
    df, size = _texts(spark)
    path = scratch_path(spark, "t-packed")
    materialize(df, "t-packed", path)
    plain = scratch_path(spark, "t-plain")
    df.write.option("compression", "snappy").parquet(plain)
    assert _bytes(spark, path) < 0.8 * _bytes(spark, plain)


def test_blocks_and_pieces_take_less_room_than_the_texts_and_a_half(spark):
    """Before, a pair took its letters, its end, its place and its count unpacked: several times the text."""
    df, size = _texts(spark)
    blocks = LX.Blocks(df, FE.words("text"), ["k"], F.length("text"), with_pairs=True)
    assert _bytes(spark, blocks.path) < 1.5 * size
    assert blocks.pieces.where("pair").agg(F.sum("n")).first()[0] > TEXTS * WORDS / 4


def _left(spark, run):
    """Bytes that ``run`` leaves in the shared folder, and the names of its folders with pieces."""
    base = ensure_checkpoint_dir(spark)
    before = _bytes(spark, base)
    out = run()
    pieces = file_system(spark, base).globStatus(hadoop_path(spark, f"{base}/text-blocks-*/part=pieces"))
    return _bytes(spark, base) - before, {p.getPath().toString() for p in pieces}, out


def test_answered_pieces_are_deleted(spark):
    df, size = _texts(spark)
    for run in (lambda: FE.bigram_perplexity(df, "k"), lambda: LM.kneser_ney_perplexity(df, "k")):
        _, old, _ = _left(spark, lambda: None)
        left, pieces, out = _left(spark, run)
        assert pieces <= old and left < size / 2  # the texts' numbers and the answers
        assert out.count() == TEXTS and out.where("perplexity > 1").count() == TEXTS


def test_words_go_to_their_answers_without_the_pairs(spark):
    """The Kneser-Ney answers of words are found among pieces of words; pieces of pairs stay where they are."""
    df, _ = _texts(spark)
    blocks = LX.Blocks(df, FE.words("text"), ["k"], F.length("text"), with_pairs=True)
    answers = LM._word_answers(blocks, LM._neighbours(blocks))
    assert answers.count() == blocks.pieces.where("not pair").count() < blocks.pieces.count()


def test_the_clean_track_leaves_its_rows_once(spark):
    """Rows travel with the blocks of their texts: they are not stored beside these, nor joined to their ids."""
    df, size = _texts(spark)
    base = ensure_checkpoint_dir(spark)
    folders = lambda: {p.getPath().toString() for p in file_system(spark, base).globStatus(hadoop_path(spark, f"{base}/clean-track-*"))}
    before = folders()
    rows = df.union(df.where("k < 3")).withColumn("platform", F.lit("p"))  # keys may repeat
    out = FE.clean_track(rows, ["platform", "k"])
    assert folders() <= before and "Join" not in out._jdf.queryExecution().optimizedPlan().toString().replace("CoGroup", "")
    back = out.select("k", "original_text", "cleaned_text", F.size(F.flatten("input_ids")).alias("n"), F.size("embedding").alias("dim")).collect()
    assert len(back) == TEXTS + 3 and {r.dim for r in back} == {768} and all(r.n == WORDS + 2 and r.original_text == r.cleaned_text for r in back)


def test_lines_that_come_twice_are_stored_once(spark):
    """Twice in a file, in two files of a batch, in a later batch; other payloads of an id too: the first arrival wins."""
    import datetime as dt
    import json

    from postloom.streaming.ingest import Store, ingest_once, run_ingest

    root = scratch_path(spark, "t-twice")
    clock = lambda: dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
    line = lambda i, **more: json.dumps({"id_str": str(i), "text": f"t{i}", "created_at": f"2024-01-0{i}T00:00:00Z"} | more)
    drop = lambda *lines: spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{root}/landing/twitter")
    drop(line(1), line(1), line(2), line(2, text="later", created_at="2024-01-09T00:00:00Z"), "{broken", "{broken")
    drop(line(1), line(3), line(3, created_at=""))
    for name, ingest in (("batch", lambda s: ingest_once(spark, {"twitter": f"{root}/landing/twitter"}, s, clock=clock)),
                         ("stream", lambda s: run_ingest(spark, {"twitter": f"{root}/landing/twitter"}, s, f"{root}/ckpt", clock))):
        store = Store(f"{root}/{name}", 2)
        ingest(store)
        got = sorted((r.post_id, r.text, str(r.created_on), r.created_at_imputed) for r in store.read(spark, "posts").collect())
        assert [g[:2] for g in got] == [("1", "t1"), ("2", "t2"), ("3", "t3")] and got[2][3] is False
        assert store.read(spark, "rejects").count() == 2
        names = {f.rsplit("/", 1)[1].split(".", 1)[1] for f in store.read(spark, "posts").inputFiles()}
        assert {n.split(".")[-2] for n in names} == {"zstd"}


def test_an_ingest_caches_no_texts_and_ended_runs_leave_no_landing_files(spark):
    from postloom.plans import q_stream

    base = ensure_checkpoint_dir(spark)
    left = lambda name: {p.getPath().toString() for p in file_system(spark, base).globStatus(hadoop_path(spark, f"{base}/{name}")) or []}
    before = {n: left(n) for n in ("sifted-*", "stream-documents-*", "stream-*/landing/*")}
    d = scratch_path(spark, "t-tables")
    docs = [(i, f"text {i} #tag", "en" if i % 3 else "de", "web", 12) for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    store = q_stream.store_of(spark, d)
    assert store.read(spark, "posts").count() > 0
    assert {n: left(n) - was for n, was in before.items()} == {n: set() for n in before}


def test_a_pair_has_one_bucket_and_the_pairs_of_a_hot_word_many():
    import numpy as np

    words = np.arange(1000) % 16
    hot = np.full(1000, 3)
    for of in (LX.pair_bucket(hot, words, 16), LX.pair_bucket(words, hot, 16)):
        assert np.bincount(of, minlength=16).max() < 2 * 1000 / 16 and (of[:16] == of[16:32]).all()
