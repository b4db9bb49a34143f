"""Corpus models against brute force: Kneser-Ney bigrams, subword pieces."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postloom.functions import text as T
from postloom.operators import features as FE
from postloom.operators import language_model as LM
from postloom.operators import subwords as SW
from postloom.session import materialize
from tests.conftest import SF001

TEXTS = [(1, "a b a b c a b"), (2, "the cat sat on the mat the cat"), (2, "the dog sat"), (3, ""), (None, "one"), (4, None), (None, "b c b c d e a"), (5, "e e e e")]


class Plain:
    """Interpolated Kneser-Ney, the plain way."""

    def __init__(self, texts):
        toks = [re.findall(r"\w+", (t or "").lower()) for t in texts]
        self.c = Counter(p for t in toks for p in zip(t, t[1:], strict=False))
        self.vocabulary = {w for t in toks for w in t}
        self.before, self.after, self.total = defaultdict(set), defaultdict(set), Counter()
        for (u, w), n in self.c.items():
            self.before[w].add(u)
            self.after[u].add(w)
            self.total[u] += n
        self.d, self.d1 = self.discount(self.c.values()), self.discount([len(x) for x in self.before.values()])

    @staticmethod
    def discount(counts):
        n1, n2 = sum(c == 1 for c in counts), sum(c == 2 for c in counts)
        return n1 / (n1 + 2 * n2) if n1 else LM.PLAIN_DISCOUNT

    def p1(self, w):
        n = len(self.c)
        rest = self.d1 * len(self.before) / n / (len(self.vocabulary) + 1)
        return max(len(self.before.get(w, ())) - self.d1, 0) / n + rest

    def p(self, u, w):
        if not self.total[u]:
            return self.p1(w)
        return max(self.c[u, w] - self.d, 0) / self.total[u] + self.d * len(self.after[u]) / self.total[u] * self.p1(w)

    def perplexity(self, text):
        t = re.findall(r"\w+", (text or "").lower())
        return math.exp(sum(-math.log(self.p(u, w)) for u, w in zip(t, t[1:], strict=False)) / (len(t) - 1)) if len(t) > 1 else 0.0


def test_kneser_ney_equals_the_plain_form(spark):
    df = spark.createDataFrame(TEXTS, "k int, text string").repartition(3)
    plain = Plain([t for _, t in TEXTS])
    got = sorted(((r.k, r.text, r.perplexity) for r in LM.kneser_ney_perplexity(df, "k", carry=["text"]).collect()), key=repr)
    want = sorted(((k, t, plain.perplexity(t)) for k, t in TEXTS), key=repr)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want, strict=True))
    # other texts under this model: unseen bigrams, contexts and words
    other = [(9, "the b zebra"), (9, "zebra quagga a e"), (10, "d c a"), (11, "zebra")]
    model = LM.kneser_ney(df)
    got = sorted((r.k, r.text, r.perplexity) for r in LM.kneser_ney_perplexity(spark.createDataFrame(other, "k int, text string"), "k", model=model, carry=["text"]).collect())
    assert [x[:2] for x in got] == sorted(other)
    assert all(abs(p - plain.perplexity(t)) < 1e-9 for _, t, p in got)


def test_kneser_ney_sums_to_one_after_each_word(spark):
    df = spark.createDataFrame(TEXTS, "k int, text string")
    model, plain = LM.kneser_ney(df), Plain([t for _, t in TEXTS])
    words = [*plain.vocabulary, "<unknown>"]
    pairs = spark.createDataFrame([(u, w) for u in [*words, "<other>"] for w in words], "prev string, w string")
    sums = LM.probability(model, pairs).groupBy("prev").agg(F.sum("p").alias("s")).collect()
    assert len(sums) == len(words) + 1 and all(abs(r.s - 1) < 1e-12 for r in sums)


def test_kneser_ney_without_bigrams(spark):
    df = spark.createDataFrame([(1, "one"), (2, None)], "k int, text string")
    assert sorted((r.k, r.perplexity) for r in LM.kneser_ney_perplexity(df, "k").collect()) == [(1, 0.0), (2, 0.0)]
    other = spark.createDataFrame([(1, "one two")], "k int, text string")
    assert LM.kneser_ney_perplexity(other, "k", model=LM.kneser_ney(df)).first().perplexity == pytest.approx(2.0)  # uniform over one word and the unknown


def test_held_out_texts_are_better_under_kneser_ney_than_under_add_one(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    train, rest = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")
    got = {r.doc_id: r.perplexity for r in LM.kneser_ney_perplexity(rest, "doc_id", model=LM.kneser_ney(materialize(train, "train"))).collect()}
    toks = lambda t: re.findall(r"[^\W]+", (t or "").lower())
    bi, uni = Counter(), Counter()
    for r in train.collect():
        t = toks(r.text)
        uni.update(t)
        bi.update(zip(t, t[1:], strict=False))
    better = total = 0
    for r in rest.collect():
        t = toks(r.text)
        if len(t) > 20:
            add_one = math.exp(sum(-math.log((bi[p] + 1) / (uni[p[0]] + len(uni) + 1)) for p in zip(t, t[1:], strict=False)) / (len(t) - 1))
            better, total = better + (got[r.doc_id] < add_one), total + 1
    assert total > 20 and better > 0.9 * total


# -- keys that repeat or are null -----------------------------------------------------------------


def test_every_row_comes_out_once_with_its_own_values(spark):
    df = spark.createDataFrame(TEXTS, "k int, text string").repartition(2)
    own = {t: r for _, t in TEXTS for r in FE.bigram_perplexity(spark.createDataFrame(TEXTS, "k int, text string"), "text").collect() if r.text == t}
    got = FE.stylometric_features(df, "k", carry=["text"]).collect()
    assert sorted(((r.k, r.text) for r in got), key=repr) == sorted(TEXTS, key=repr)
    assert all(abs(r.perplexity - own[r.text].perplexity) < 1e-9 for r in got)
    cleaned = df.withColumn("c", T.clean_text("text"))
    words = {r.id: r.word for r in FE.build_vocabulary(cleaned.select(FE.clean_words("c").alias("tokens"))).collect()}
    seqs = FE.token_ids(materialize(cleaned, "cleaned"), "k", "c", max_len=5).collect()
    texts = Counter()
    for k in {r.k for r in seqs}:
        mine = sorted((r.seq_no, r.input_ids) for r in seqs if r.k == k)
        if len([s for s, _ in mine if s == 0]) == 1:
            texts[k, " ".join(words[i] for _, s in mine for i in s[1:-1])] += 1
    assert texts[1, "a b a b c a b"] == 1 and texts[5, "e e e e"] == 1
    assert sorted(len([1 for r in seqs if r.k == k and r.seq_no == 0]) for k in (2, None)) == [2, 2]
    padded = FE.pad_batches(FE.token_ids(materialize(cleaned, "cleaned"), "k", "c", max_len=5), ["k", "seq_no"], batch_size=4).collect()
    assert len(padded) == len(seqs)
    assert sorted([i for i in r.input_ids if i != FE.PAD] for r in padded) == sorted(r.input_ids for r in seqs)


def test_clean_track_keeps_rows_with_null_and_repeated_keys(spark):
    rows = [("x", "1", "a b c"), ("x", "1", "x y z"), (None, "2", "one two"), ("x", None, "three"), ("y", "3", "..."), ("y", "4", None)]
    out = FE.clean_track(spark.createDataFrame(rows, "platform string, post_id string, text string"), ["platform", "post_id"], dim=4).collect()
    assert sorted(((r.platform, r.post_id, r.original_text) for r in out), key=repr) == sorted([r for r in rows[:4]], key=repr)
    ids = {r.original_text: [i for s in r.input_ids for i in s[1:-1]] for r in out}
    assert [len(ids[t]) for t in ("a b c", "x y z", "one two", "three")] == [3, 3, 2, 1]
    assert not set(ids["a b c"]) & set(ids["x y z"]) and all(r.split_group for r in out)


# -- subwords -------------------------------------------------------------------------------------

CORPUS = "low lower lowest newer newest new wide wider widest low low newer slow slower slowest follow following".split()


def segmentations(word, logs):
    if not word:
        return [([], 0.0)]
    return [([word[:k], *rest], logs[word[:k]] + p) for k in range(1, len(word) + 1) if word[:k] in logs for rest, p in segmentations(word[k:], logs)]


def brute_expected(word, logs):
    every = segmentations(word, logs)
    total = sum(math.exp(p) for _, p in every)
    out = Counter()
    for pieces, p in every:
        for x in pieces:
            out[x] += math.exp(p) / total
    return out


def test_expected_counts_and_best_pieces_against_all_segmentations():
    counts = Counter()
    for w in CORPUS:
        word = SW.START + w
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + 5) + 1):
                counts[word[i:j]] += 1
    logs = SW.normalised({p: float(n) for p, n in counts.items()})
    for w in {*CORPUS, "lowing", "west"}:
        word = SW.START + w
        got, want = SW.expected_counts(word, logs), brute_expected(word, logs)
        assert all(abs(got.get(p, 0) - x) < 1e-9 for p, x in want.items())
        best = max(p for _, p in segmentations(word, logs))
        assert sum(logs[p] for p in SW.best_pieces(word, logs, -20.0)) == pytest.approx(best)


def test_training_in_spark_equals_training_in_one_process(spark):
    df = spark.createDataFrame([(w,) for w in CORPUS * 3], "w string").repartition(4)
    words = materialize(SW.count_words(df, F.array("w")), "words")
    pieces = SW.train(words, size=30, seeds=60)
    counted = Counter(SW.START + w for w in CORPUS * 3)
    seeds = Counter()
    for w, n in counted.items():
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + SW.LONGEST + 1) + 1):
                seeds[w[i:j]] += n
    chars = {p: float(n) for p, n in seeds.items() if len(p) == 1}
    long_ = sorted((p for p, n in seeds.items() if len(p) > 1 and n > 1), key=lambda p: (-seeds[p] * len(p), p))[:60]
    assert SW.seed_pieces(words, 60) == chars | {p: float(seeds[p]) for p in long_}

    def expect(counts):
        logs, total = SW.normalised(counts), Counter()
        for w, n in counted.items():
            for p, x in brute_expected(w, logs).items():
                total[p] += n * x
        return SW.used(total, counts)

    want = SW.learn(chars | {p: float(seeds[p]) for p in long_}, 30, expect)
    assert pieces.logs.keys() == want.keys() and len(want) <= max(30, len(chars))
    assert all(abs(pieces.logs[p] - want[p]) < 1e-6 for p in want)


def test_seeds_are_the_best_of_all_substrings(spark):
    counted = {SW.START + w: n for n, w in enumerate(["international", "nationality", "rationally", "abcdefghijkl", "aaaaaaaaaaaa", "zz", "ab"], 1)}
    words = materialize(spark.createDataFrame(list(counted.items()), "word string, n long"), "words")
    every = Counter()
    for w, n in counted.items():
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + SW.LONGEST + 1) + 1):
                every[w[i:j]] += n
    for seeds in (1, 5, 40, 100_000):
        best = sorted((p for p, n in every.items() if len(p) > 1 and n > 1), key=lambda p: (-every[p] * len(p), p))[:seeds]
        assert SW.seed_pieces(words, seeds) == {p: float(n) for p, n in every.items() if len(p) == 1 or p in best}


def test_many_words_at_a_time_are_as_one_by_one(monkeypatch):
    words = [SW.START + w for w in [*CORPUS, "", "lowlowlowlow" * 9, "漢字low"]]
    n = np.arange(1, len(words) + 1)
    counts = Counter(w[i:j] for w in words[:-1] for i in range(len(w)) for j in range(i + 1, min(len(w), i + 5) + 1))
    logs = SW.normalised({p: float(c) for p, c in counts.items()})
    want = Counter()
    for w, k in zip(words, n.tolist(), strict=True):
        for p, x in SW.expected_counts(w, logs).items():
            want[p] += k * x
    pieces = SW.Pieces.of(logs)
    texts = [["low", "漢字low", "newest"], [], None, ["low"], ["😀"]]
    for chars in (1, 20, 1 << 17):
        monkeypatch.setattr(SW, "CHARS", chars)
        got = dict(zip(logs, SW.expectation(words, n, SW.Trie(logs)).tolist(), strict=True))
        assert got == pytest.approx({p: want[p] for p in logs})
        ids = pieces.encode_lists(pa.array(texts, pa.list_(pa.string())))
        assert ids.to_pylist() == [[i for w in t or [] for i in pieces.encode([w])] for t in texts]
        assert pieces.decode_lists(ids).to_pylist() == [" ".join(t or []) for t in texts]


def test_texts_are_encoded_once_whatever_uses_their_ids(spark):
    docs = materialize(spark.createDataFrame([(1, "low newest")], "k int, c string"), "t-docs")
    words = F.split("c", " ")
    pieces = SW.Pieces.of(SW.normalised({c: 1.0 for c in SW.START + "lownest"}))
    ids = docs.select("k", SW.piece_ids(pieces, docs, words).alias("ids"))
    out = ids.select("k", SW.decoded(pieces, docs, F.col("ids")).alias("decoded"), F.size("ids").alias("n"))
    assert len([x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "ArrowEvalPython" in x and "encode(" in x]) == 1
    assert [tuple(r) for r in out.collect()] == [(1, "low newest", 11)]


def test_no_word_is_unknown_and_ids_decode(spark):
    df = spark.createDataFrame([(1, "low lower lowest new newest"), (2, "unseen Wörter 漢字 😀 zzz"), (3, ""), (3, None), (None, "slow")], "k int, c string")
    train = spark.createDataFrame([(w,) for w in CORPUS], "w string")
    pieces = SW.train(SW.count_words(train, F.array("w")), size=40, seeds=80)
    assert SW.START in pieces.logs
    rows = SW.subword_sequences(df, "k", "c", pieces, max_len=7).collect()
    texts = Counter()
    for k in (1, 2):
        mine = sorted((r.seq_no, r.input_ids) for r in rows if r.k == k)
        assert all(s[0] == FE.CLS and s[-1] == FE.SEP and len(s) <= 7 for _, s in mine)
        flat = [i for _, s in mine for i in s[1:-1]]
        assert FE.UNK not in flat and max(flat) < SW.FIRST_PIECE + len(pieces.ids)
        texts[pieces.decode(flat)] += 1
    assert texts == {"low lower lowest new newest": 1, "unseen Wörter 漢字 😀 zzz": 1}
    assert sorted(len(r.input_ids) for r in rows if r.k == 3) == [2, 2]
    table = pieces.table(spark)
    assert table.count() == len(pieces.ids) and table.agg(F.sum(F.exp("log_p"))).first()[0] == pytest.approx(1.0)
    assert SW.train(SW.count_words(spark.createDataFrame([], "w string"), F.array("w"))).logs == {}


# -- dense vectors --------------------------------------------------------------------------------


def tfidf(rows, features):
    import numpy as np

    a = np.zeros((len(rows), features))
    for k, cols in enumerate(rows):
        for c, n in Counter(cols).items():
            a[k, c] = 1 + math.log(n)
    a *= np.log((1 + len(rows)) / (1 + (a > 0).sum(0))) + 1
    norm = np.sqrt((a * a).sum(1, keepdims=True))
    return a / np.where(norm > 0, norm, 1)


def test_svd_vectors_reconstruct_as_well_as_numpy(spark, monkeypatch):
    import numpy as np

    from postloom.operators import dense as DE

    monkeypatch.setattr(DE, "FAN", 2)  # several levels of the tree of sums
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", T.clean_text("text").alias("c"))
    rows = materialize(docs.select("doc_id", DE.hashed(FE.clean_words("c"), 512).alias("columns")).repartition(5), "hashed")
    got = rows.orderBy("doc_id").collect()
    a = tfidf([r["columns"] for r in got], 512)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    for dim in (4, 20):
        v = DE.learn(rows.select("columns"), dim, 512)
        assert np.allclose(v.singular, s[:dim], rtol=0.05)
        best = np.linalg.norm(a - (u[:, :dim] * s[:dim]) @ vt[:dim])
        assert np.linalg.norm(a - a @ v.right @ v.right.T) <= 1.05 * best
        assert np.allclose(v.right.T @ v.right, np.eye(dim), atol=1e-8)
        out = {r.doc_id: np.array(r.embedding) for r in DE.project(rows, v, unit=False).collect()}
        assert np.allclose(np.stack([out[r.doc_id] for r in got]), a @ v.right, atol=1e-5)


def test_svd_edges(spark):
    from postloom.operators import dense as DE

    df = spark.createDataFrame([(1, "a b c"), (1, "x y"), (None, "a b"), (2, ""), (2, None)], "k int, c string")
    out = DE.svd_embedding(df, "k", "c", dim=3, features=64).collect()
    assert sorted((str(r.k) for r in out)) == ["1", "1", "2", "2", "None"]
    assert all(len(r.embedding) == 3 for r in out)
    assert all(abs(sum(x * x for x in r.embedding) - (0 if r.k == 2 else 1)) < 1e-5 for r in out)
    assert DE.svd_embedding(spark.createDataFrame([], "k int, c string"), "k", "c", dim=3, features=64).count() == 0


# -- sentences ------------------------------------------------------------------------------------


def test_abbreviations_do_not_end_a_sentence(spark):
    from postloom.operators import sentences as SE

    ends = ["here", "more", "left", "road", "came"]  # seen inside sentences as well as at their ends
    plain = [f"The {ends[k % 5]} one is {ends[(k + 1) % 5]}. It has a {ends[(k + 2) % 5]} of size {k % 7}. We saw word{k} and {ends[(k + 3) % 5]}." for k in range(150)]
    some = [f"Mr. Smith met Dr. Jones at {k} p.m. on the road. They spoke, e.g. about J. Doe etc. and left." for k in range(40)]
    rows = list(enumerate(plain + some)) + [(None, "Dr. No came. He left."), (0, "Dr. No came. He left."), (900, ""), (901, None), (902, "One. Two! Three? Four... five.")]
    df = spark.createDataFrame(rows, "k int, text string").repartition(3)
    found = {r.word for r in SE.abbreviations(materialize(SE.type_counts(df), "types")).collect()}
    assert {"mr", "dr", "p.m", "e.g", "etc", "j"} <= found
    assert not {*ends, "1", "5"} & found
    got = sorted(((r.k, r.text, r.lengths) for r in SE.sentence_lengths(df, "k", carry=["text"]).collect()), key=repr)
    assert sorted(((k, t) for k, t, _ in got), key=repr) == sorted(rows, key=repr)
    by_text = {t: x for _, t, x in got}
    assert all(len(by_text[t]) == 3 for t in plain) and all(len(by_text[t]) == 2 for t in some)
    assert len(by_text["Dr. No came. He left."]) == 2 and by_text[""] == [] and by_text[None] == [] and len(by_text["One. Two! Three? Four... five."]) == 5
    flat = {r.k: r.burstiness for r in SE.learned_burstiness(df, "k").collect()}
    x = by_text[plain[3]]
    assert flat[3] == pytest.approx(sum((v - sum(x) / 3) ** 2 for v in x) / 3) and flat[901] == 0.0


def test_texts_without_periods_have_no_abbreviations(spark):
    from postloom.operators import sentences as SE

    df = spark.createDataFrame([(1, "no end here"), (2, "nor here! yes")], "k int, text string")
    assert SE.abbreviations(materialize(SE.type_counts(df), "types")).count() == 0
    assert sorted((r.k, r.lengths) for r in SE.sentence_lengths(df, "k").collect()) == [(1, [3]), (2, [3, 1])]


def test_counts_and_lookups_by_blocks_do_not_depend_on_the_cut(spark, monkeypatch):
    """Blocks of a few words, several buckets, repeated and null keys, texts without words: as counted by hand."""
    import math
    from collections import Counter

    from postloom.operators import features as FE
    from postloom.operators import lexicon as LX

    texts = ["a b a b c", "b a", "a", "", None, "été a b", "c c c c c c c c c c c c", "a b a b c"]
    rows = [(None if i == 2 else i % 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k int, text string")
    toks = [(t or "").split() for t in texts]
    one, two = Counter(w for t in toks for w in t), Counter(p for t in toks for p in zip(t, t[1:]))
    want = []
    for (k, t), ws in zip(rows, toks):
        logs = [-math.log((two[p] + 1) / (one[p[0]] + len(one))) for p in zip(ws, ws[1:])]
        want.append((str(k), round(math.exp(sum(logs) / len(logs)), 9) if logs else 0.0))
    seen = {}
    for block, chars in ((1 << 19, 1 << 23), (3, 2)):
        monkeypatch.setattr(LX, "BLOCK", block)
        monkeypatch.setattr(LX, "CHARS", chars)
        got = [(str(r.k), round(r.perplexity, 9)) for r in FE.bigram_perplexity(df, "k").collect()]
        assert sorted(got) == sorted(want)
        ids = FE.token_ids(df, "k", "text", max_len=6)
        seen[block] = sorted((str(r.k), r.seq_no, tuple(r.input_ids)) for r in ids.collect())
    assert seen[3] == seen[1 << 19] and sum(len(x[2]) - 2 for x in seen[3]) == sum(map(len, toks))
    assert LX.Blocks(df, FE.words("text"), ["k"], FE.F.length("text")).pieces.columns == [c.split()[0] for c in LX.PIECE.split(", ")]


def test_a_hot_word_is_one_entry_of_a_block(spark):
    from postloom.operators import features as FE
    from postloom.operators import lexicon as LX

    df = spark.range(2000).selectExpr("id", "concat('hot hot hot w', id % 7) AS text").coalesce(1)
    blocks = LX.Blocks(df, FE.words("text"), ["id"], FE.F.length("text"))
    assert blocks.pieces.count() <= 8  # a piece per block and bucket, not 8000 words
    assert {r.word: r.cnt for r in blocks.words().collect()} == {"hot": 6000} | {f"w{i}": len(range(i, 2000, 7)) for i in range(7)}


def test_products_take_time_and_memory_of_the_entries_not_of_a_dense_block():
    """Every text has words of its own: a dense block of the texts' words would hold 4096 x 32768 numbers (1 GB)."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from postloom.operators import dense as DE

    rng = np.random.default_rng(1)
    columns = rng.integers(0, DE.FEATURES, (4096, 20)).astype(np.int32)
    idf, x = rng.random(DE.FEATURES) + 1, rng.normal(size=(DE.FEATURES, 5))
    tracemalloc.start()
    blocks = [(i, j, DE._times(j - i, *entries, x)) for i, j, *entries in DE._weighted(pa.array(list(columns)), idf)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and [b[:2] for b in blocks][-1][1] == 4096
    for i in (0, 4095):
        col, tf = np.unique(columns[i], return_counts=True)
        w = (1 + np.log(tf)) * idf[col]
        got = next(y[i - a] for a, b, y in blocks if a <= i < b)
        assert np.allclose(got, (w / np.linalg.norm(w)) @ x[col])


def test_the_wide_embedding_is_the_embedding(spark):
    from postloom.operators import features as FE

    df = spark.createDataFrame([("a b a",), ("",), (None,), ("été x y z x x",)], "t string")
    got = df.select(FE.embedding(FE.clean_words("t"), 7).alias("a"), FE.wide_embedding(FE.clean_words("t"), 7).alias("b")).collect()
    assert all(r.a == r.b for r in got) and len(got) == 4
