"""an interpolated Kneser-Ney bigram model of the corpus, counted and scored in Spark.

    p(w | u)  = max(c(u w) - D, 0) / c(u) + D * N(u .) / c(u) * p1(w)
    p1(w)     = max(N(. w) - D1, 0) / N(. .) + D1 * W / N(. .) / (V + 1)

``c`` counts bigrams (c(u): those that begin with u), ``N(u .)`` distinct successors, ``N(. w)`` distinct
predecessors, ``N(. .)`` distinct bigrams, ``W`` words with a predecessor, ``V`` words.  Each discount is
n1 / (n1 + 2 n2) of its level's counts of counts (``PLAIN_DISCOUNT`` where no count is 1).  The last
term is uniform over the words and one class for unknown ones, so the probabilities that follow
any word sum to 1 over the vocabulary and that class; after an unknown word they are p1.

Plan: bigrams are counted per text first, then per corpus; what is stored is one row per distinct
bigram, per word and per context.  Texts scored with a model of other texts look their bigrams up as in
``features`` (hot ones by broadcast, the rest by hash), and words and contexts for bigrams that the model
has not seen.  Texts scored with their own model get its numbers by blocks (``lexicon``)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.operators import features as FE
from postloom.operators import lexicon as LX
from postloom.session import discard, materialize, scratch_path

PLAIN_DISCOUNT = 0.5


@dataclass(frozen=True)
class KneserNey:
    bigrams: DataFrame  # prev, w, c_bw, nll
    contexts: DataFrame  # prev, c_prev, back_off
    words: DataFrame  # w, n_before, p1 (words with a predecessor)
    unseen: float  # p1 of a word without a predecessor, known or not
    discounts: tuple[float, float]


def _discount(counts: DataFrame, c: str) -> float:
    n1, n2 = counts.agg(F.count(F.when(F.col(c) == 1, 1)), F.count(F.when(F.col(c) == 2, 1))).first()
    return n1 / (n1 + 2 * n2) if n1 else PLAIN_DISCOUNT


def kneser_ney(df: DataFrame, text: str = "text", max_tokens: int | None = None) -> KneserNey:
    """The model of the texts (whole ones, unless ``max_tokens`` cuts them)."""
    counts = materialize(FE.bigram_counts(df, text, max_tokens), "kn-counts")  # every token is some prev, the last with a NULL w
    pairs = counts.where("w is not null")
    vocabulary = counts.agg(F.countDistinct("prev")).first()[0]
    by_word = materialize(pairs.groupBy("w").agg(F.count("*").alias("n_before"), F.sum("c_bw").alias("c_w")), "kn-words")
    d, d1 = _discount(pairs, "c_bw"), _discount(by_word, "n_before")
    types, followers = by_word.agg(F.coalesce(F.sum("n_before"), F.lit(0)), F.count("*")).first()
    unseen = d1 * followers / types / (vocabulary + 1) if types else 1.0 / (vocabulary + 1)
    p1 = F.greatest(F.col("n_before") - d1, F.lit(0.0)) / F.lit(types) + F.lit(unseen)
    words = materialize(by_word.select("w", "n_before", "c_w", p1.alias("p1")), "kn-p1")
    by_prev = pairs.groupBy("prev").agg(F.sum("c_bw").alias("c_prev"), F.count("*").alias("n_after"))
    contexts = materialize(by_prev.select("prev", "c_prev", (F.lit(d) * F.col("n_after") / F.col("c_prev")).alias("back_off")), "kn-contexts")
    p = F.greatest(F.col("c_bw") - d, F.lit(0.0)) / F.col("c_prev") + F.col("back_off") * F.col("p1")
    scored = pairs.join(contexts, "prev").join(words.select("w", "p1"), "w").select("prev", "w", "c_bw", (-F.log(p)).alias("nll"))
    return KneserNey(materialize(scored, "kn-bigrams"), contexts, words, unseen, (d, d1))


def _look_up(model: KneserNey):
    def run(occ: DataFrame) -> DataFrame:
        found = FE._look_up(occ, model.bigrams, ["prev", "w"], "nll", "c_bw", [FE.ROW])
        known = found.withColumnRenamed("nll", "__nll")
        with_prev = FE._look_up(known, model.contexts, ["prev"], "back_off", "c_prev", [FE.ROW])
        both = FE._look_up(with_prev, model.words, ["w"], "p1", "c_w", [FE.ROW])
        rest = F.coalesce("back_off", F.lit(1.0)) * F.coalesce("p1", F.lit(model.unseen))
        return both.select(*occ.columns, F.when(F.col("w").isNotNull(), F.coalesce("__nll", -F.log(rest))).alias("nll"))

    return run


_SPREAD = "bucket int, n int, data binary, ones long, twos long"


def _neighbours(blocks: LX.Blocks) -> DataFrame:
    """From each bucket's distinct pairs, to the buckets of their words: pairs that begin with the word (occurrences,
    distinct ones) and distinct pairs that end with it; with the pairs that occur once and twice (on one row)."""
    buckets = blocks.buckets

    def run(t: pa.Table) -> pa.Table:
        keys, n = LX.entries(t["data"].to_pylist(), t["n"].to_pylist())
        keys = keys.dictionary_encode()
        total = np.bincount(keys.indices.to_numpy(), weights=n[:, 0], minlength=len(keys.dictionary))
        both = pc.split_pattern(keys.dictionary, " ").flatten()
        first = np.arange(len(both)) % 2 == 0
        words = both.dictionary_encode()
        code, m = words.indices.to_numpy(), len(words.dictionary)
        three = np.stack([np.bincount(code[first], weights=total, minlength=m), np.bincount(code[first], minlength=m), np.bincount(code[~first], minlength=m)], 1)
        bucket = (LX.bucket_hash(words.dictionary) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows = [(b, k, x) for b, _, k, x in LX.dealt(words.dictionary.take(pa.array(order)), three[order], bucket[order])]
        columns = list(zip(*rows, strict=True))
        seen = lambda x: pa.array([int((total == x).sum())] + [0] * (len(rows) - 1), pa.int64())
        return pa.table({"bucket": pa.array(columns[0], pa.int32()), "n": pa.array(columns[1], pa.int32()), "data": pa.array(columns[2], pa.binary()),
                         "ones": seen(1), "twos": seen(2)})

    return blocks.pieces.where("pair").groupBy("bucket").applyInArrow(run, _SPREAD)


def _word_answers(blocks: LX.Blocks, spread: DataFrame) -> DataFrame:
    """Answers for the words of each block (three values each) and of each bucket the sums that the model needs (on one row)."""

    def run(p: pa.Table, t: pa.Table) -> pa.Table:
        known, three = LX.entries(t["data"].to_pylist(), t["n"].to_pylist(), 3)
        known = known.dictionary_encode()
        code, m = known.indices.to_numpy(), len(known.dictionary)
        sums = np.stack([np.bincount(code, weights=three[:, c], minlength=m) for c in range(3)], 1).astype(np.int64)
        before = sums[:, 2]
        answers = np.concatenate([np.zeros((1, 3), np.int64), sums])
        values = []
        for data, n in zip(p["data"].to_pylist(), p["n"].to_pylist(), strict=True):
            place = pc.index_in(LX.entries([data], [n])[0], value_set=known.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
            values.append(answers[place + 1])
        here = lambda x: pa.array(([int(x)] + [0] * len(values))[: len(values)], pa.int64())
        return LX.answer(p, values, 1, types=here(before.sum()), followers=here((before > 0).sum()), ones=here((before == 1).sum()), twos=here((before == 2).sum()))

    return blocks.pieces.where("not pair").groupBy("bucket").cogroup(spread.groupBy("bucket")).applyInArrow(
        run, f"{LX.ANSWER}, types long, followers long, ones long, twos long")


def _own_perplexity(blocks: LX.Blocks) -> DataFrame:
    """``carried`` and perplexity of every text under the model of all of them: the same numbers as ``kneser_ney``
    gives, brought to the texts by blocks, without a table of scored bigrams.  Of an entry a block gets the count, and of
    a word how often, and before and after how many it stands."""

    def share(n1: int, n2: int) -> float:
        return n1 / (n1 + 2 * n2) if n1 else PLAIN_DISCOUNT

    of_pairs = materialize(LX.bigram_answers(blocks), "kn-counts")
    path = scratch_path(blocks.spark, "kn-neighbours")
    spread = materialize(_neighbours(blocks), "kn-neighbours", path)
    of_words = materialize(_word_answers(blocks, spread), "kn-words")
    blocks.done()
    vocabulary = of_pairs.agg(F.sum("words")).first()[0] or 0
    d = share(*[x or 0 for x in spread.agg(F.sum("ones"), F.sum("twos")).first()])
    discard(blocks.spark, path)
    types, followers, n1, n2 = [x or 0 for x in of_words.agg(*[F.sum(c) for c in ("types", "followers", "ones", "twos")]).first()]
    d1 = share(n1, n2)

    def make(codes: np.ndarray, sizes: np.ndarray, values: np.ndarray, pairs: tuple) -> dict:
        u, w, _, place = pairs
        n_words = int(codes.max()) + 1 if len(codes) else 0
        if not len(u):
            return {"perplexity": pa.array(np.zeros(len(sizes)))}
        c_prev, n_after, n_before = values[u, 1], values[u, 2], values[w, 3]
        p1 = np.maximum(n_before - d1, 0) / max(types, 1) + d1 * followers / max(types, 1) / (vocabulary + 1)
        p = np.maximum(values[n_words:, 0] - d, 0) / c_prev + d * n_after / c_prev * p1
        return {"perplexity": pa.array(LX.mean_of_pairs(sizes, -np.log(p)[place]))}

    both = of_pairs.select(*LX.NAMES).unionByName(of_words.select(*LX.NAMES))
    return blocks.answered(both, make, "perplexity double")


def kneser_ney_perplexity(df: DataFrame, key: str | list[str], text: str = "text", model: KneserNey | None = None,
                          max_tokens: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """Perplexity of every row (0.0 for fewer than two tokens) under ``model``, by default that of the texts
    themselves; with its keys and ``carry`` columns, one row per row given."""
    columns = [*FE._keys(key), *(carry or [])]
    if model is None:
        toks = F.slice(FE.words(text), 1, max_tokens) if max_tokens else FE.words(text)
        blocks = LX.Blocks(df, toks, columns, F.length(text), with_pairs=True)
        return _own_perplexity(blocks).select("carried.*", "perplexity")
    return FE._scored_texts(df, columns, text, max_tokens, _look_up(model))


def probability(model: KneserNey, pairs: DataFrame) -> DataFrame:
    """``pairs`` (prev, w) and p, seen or not."""
    numbered = pairs.withColumn(FE.ROW, F.monotonically_increasing_id())
    p: Column = F.exp(-F.col("nll"))
    return _look_up(model)(numbered).select(*pairs.columns, p.alias("p"))
