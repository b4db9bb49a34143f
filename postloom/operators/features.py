"""Feature operators: stylometric feature table, corpus bigram perplexity,
vocabulary token ids with per-batch padding, hashed bag-of-words embedding,
the clean-track job, and a batched model hook.

No pretrained weights ship with this library, so perplexity, token ids and
embeddings are built from the corpus itself (see README); ``model_hook`` is
where a real scorer plugs in.

Scale notes
-----------
* Words and bigrams of the corpus are counted and looked up by blocks of texts
  (``lexicon``), so no row per word is shuffled.  Where the model is that of other
  texts, they are grouped inside their row (sorted, then cut into runs).
* Lookups of a word or bigram (``_look_up``) never send a hot one to one task:
  those with more than a thousandth of all occurrences number a thousand at
  most, whatever the corpus, and are broadcast; the rest meet in a shuffle join.
* Every distinct corpus word has an id (an exact rank, no top-V), and every
  token of a text reaches a sequence.
* Per-text regrouping is bounded by the text itself, never by the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from postloom import config
from postloom.functions import stylometry as ST
from postloom.functions import text as T
from postloom.operators import lexicon as LX
from postloom.operators.sampling import exact_rank
from postloom.session import discard, materialize, scratch_path

WORD_RE = f"{T.WORD}+"
PAD, UNK, CLS, SEP = 0, 1, 2, 3
FIRST_WORD_ID = 4
VECTOR_ROWS = 1024  # vectors that are counted together
LETTERS = 8  # of a word, for the sizes of buckets


def words(c) -> Column:
    """Lower-cased word tokens of the whole text."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(T.FAST_WORD_RE), 0)


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


ROW = "__row"  # a row's own number: texts are told apart by it, never by their keys, which may repeat or be null


def _with_row(df: DataFrame) -> DataFrame:
    return df if ROW in df.columns else df.withColumn(ROW, F.monotonically_increasing_id())


def _carried(df: DataFrame, columns: list[str], parts: Column, alias: str) -> DataFrame:
    """(row number, carried struct, ``alias``): one row per element of ``parts``, one at least; the
    carried columns travel with a row's first element only."""
    place = f"{alias}_at"
    rows = _with_row(df).select(ROW, F.struct(*columns).alias("__carried"), F.posexplode_outer(parts).alias(place, alias))
    return rows.select(ROW, F.when(F.coalesce(F.col(place), F.lit(0)) == 0, F.col("__carried")).alias("__carried"), alias)


def _one(columns: list[str]) -> tuple[Column, list[Column]]:
    """The aggregate that brings a row's carried columns back, and their names."""
    return F.first("__carried", ignorenulls=True).alias("__carried"), [F.col("__carried").getField(c).alias(c) for c in columns]


def _runs(ordered: Column, same: Callable[[Column], Column], make: Callable[[Column, Column], Column]) -> Column:
    """Cut a sorted array into runs of equal ``same(element)``; ``make(first, run)`` per run."""
    def cut(s: Column) -> Column:
        index = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(index, lambda k: (k == 0) | ~same(F.get(s, k)).eqNullSafe(same(F.get(s, k - 1))))
        return F.transform(F.array(starts), lambda at: F.transform(
            at, lambda k, j: make(s[k], F.slice(s, k + 1, F.coalesce(F.get(at, j + 1), F.size(s)) - k))))[0]

    return F.transform(F.array(ordered), cut)[0]


HOT_SHARE = 1000  # a value with more than 1 / HOT_SHARE of all occurrences is hot: HOT_SHARE rows at most
SALTS = 4096


def _look_up(rows: DataFrame, table: DataFrame, on: list[str], value: str, count: str, spread: list[str]) -> DataFrame:
    """``rows`` with ``value`` of ``table`` (one stored row per ``on``; ``count`` its occurrences), NULL
    where there is none.  A NULL in ``on`` meets nothing.

    Hot entries are broadcast.  Rows that they answer, and rows that cannot meet any, are spread over the
    shuffle by a salt of their ``spread`` columns; the others meet the table by hash."""
    total = table.select(F.sum(count)).scalar()
    hot = table.where(F.col(count) * HOT_SHARE > total).select(*[F.col(c).alias(f"__h_{c}") for c in on], F.col(value).alias("__hot"))
    match = lambda p: [F.col(c) == F.col(f"{p}{c}") for c in on]
    first = rows.join(F.broadcast(hot), match("__h_"), "left").drop(*[f"__h_{c}" for c in on])
    done = F.col("__hot").isNotNull()
    for c in on:
        done = done | F.col(c).isNull()
    salt = F.when(done, F.pmod(F.xxhash64(*spread), F.lit(SALTS)) + 1).otherwise(F.lit(0)).cast("int")
    # a NULL key would send its rows to one task whatever the salt: for the join it is empty
    cold = table.select(*[F.col(c).alias(f"__c_{c}") for c in on], F.col(value).alias("__cold"), F.lit(0).alias("__c_salt"))
    meet = [F.coalesce(F.col(c), F.lit("")) == F.col(f"__c_{c}") for c in on]
    joined = first.withColumn("__salt", salt).join(cold, [*meet, F.col("__salt") == F.col("__c_salt")], "left")
    return joined.select(*rows.columns, F.coalesce("__hot", "__cold").alias(value))


def _bigram_runs(text: str, max_tokens: int | None) -> Column:
    """Distinct bigrams (prev, w) of a text with their counts; the last token has a NULL successor."""
    toks = words(text)
    if max_tokens:
        toks = F.slice(toks, 1, max_tokens)
    pairs = F.transform(F.array(toks), lambda t: F.transform(t, lambda w, i: F.struct(w.alias("prev"), F.get(t, i + 1).alias("w"))))[0]
    return _runs(F.sort_array(pairs), lambda x: x, lambda x, run: F.struct(x["prev"].alias("prev"), x["w"].alias("w"), F.size(run).cast("long").alias("k")))


def bigram_counts(df: DataFrame, text: str = "text", max_tokens: int | None = None) -> DataFrame:
    """(prev, w, c_bw) over all texts; w is NULL for the last token of a text."""
    occ = df.select(F.explode(_bigram_runs(text, max_tokens)).alias("b"))
    return occ.groupBy("b.prev", "b.w").agg(F.sum("b.k").alias("c_bw"))


def _scored_texts(df: DataFrame, columns: list[str], text: str, max_tokens: int | None, look_up) -> DataFrame:
    """``columns`` and perplexity of every row: exp of the mean ``nll`` that ``look_up`` gives its
    bigrams, 0.0 for fewer than two tokens."""
    occ = _carried(df, columns, _bigram_runs(text, max_tokens), "b").select(ROW, "__carried", "b.prev", "b.w", "b.k")
    found = look_up(occ)
    mean = F.sum(F.col("nll") * F.col("k")) / F.sum(F.when(F.col("w").isNotNull(), F.col("k")))
    carried, named = _one(columns)
    return found.groupBy(ROW).agg(F.coalesce(F.exp(mean), F.lit(0.0)).alias("__perplexity"), carried).select(*named, F.col("__perplexity").alias("perplexity"))


def bigram_perplexity(df: DataFrame, key: str | list[str], text: str = "text", max_tokens: int | None = None,
                      carry: list[str] | None = None) -> DataFrame:
    """F4 (re-aimed): per text, exp(mean negative log-likelihood) of its bigrams
    under an add-one corpus bigram model, p = (c(prev, w) + 1) / (c(prev) + V).
    Texts with fewer than two tokens get 0.0.  ``max_tokens`` optionally
    applies a model window; by default the whole text is scored.  One row per row
    given, with its keys and the ``carry`` columns (keys may repeat or be null).

    Bigrams and words are counted, and the counts brought back to the texts, by blocks of texts
    (``lexicon``): a hot word is one entry of a block."""
    toks = words(text)
    if max_tokens:
        toks = F.slice(toks, 1, max_tokens)
    blocks = LX.Blocks(df, toks, [*_keys(key), *(carry or [])], F.length(text), with_pairs=True)
    return LX.add_one_perplexity(blocks).select("carried.*", "perplexity")


def stylometric_features(df: DataFrame, key: str | list[str], text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per text with its keys, the ``carry`` columns, burstiness, punctuation
    density, lexical diversity and perplexity.  The row-wise features travel with the row."""
    own = {"burstiness": ST.burstiness(text), "punctuation_density": ST.punctuation_density(text), "lexical_diversity": ST.lexical_diversity(text)}
    # named apart from the input's columns until the end
    base = df.select("*", *[c.alias(f"__f_{n}") for n, c in own.items()])
    out = bigram_perplexity(base, key, text, carry=[*(carry or []), *[f"__f_{n}" for n in own]])
    return out.select(*_keys(key), *(carry or []), *[F.col(f"__f_{n}").alias(n) for n in own], "perplexity")


def clean_words(c) -> Column:
    """Words of an already cleaned text (single spaces, no punctuation)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(col, " "), lambda w: w != "")


def _ranked_words(counts: DataFrame, seed: str = "vocab") -> DataFrame:
    ranked = exact_rank(materialize(counts.select("word", "cnt"), "word-counts"), [], seed, ["word"], rank_col="id")
    return ranked.select("word", "cnt", (F.col("id") + FIRST_WORD_ID).cast("int").alias("id"))


def build_vocabulary(tokens: DataFrame, col: str = "tokens", seed: str = "vocab") -> DataFrame:
    """(word, cnt, id) for every distinct word: ids from 4 (0 pad, 1 unknown, 2 start, 3 end) by an
    exact rank, so the vocabulary may be of any size."""
    return _ranked_words(tokens.select(F.explode(col).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt")), seed)


def token_ids(df: DataFrame, key: str | list[str], cleaned: str, vocab: DataFrame | None = None,
              max_len: int = config.MAX_SEQUENCE_TOKENS) -> DataFrame:
    """F6 (re-aimed): ``[start] ids... [end]`` sequences of at most ``max_len`` ids (the encoder's
    input limit): (key, seq_no, input_ids).  A longer text gives consecutive sequences, so no
    token is lost; a text without words gives one of the two marks.  ``vocab`` (a stored table,
    by default that of the corpus itself) may lack words: those get id 1.  Each row has sequences of
    its own, also if its key repeats or is null."""
    keys = _keys(key)
    toks = df.select(*keys, clean_words(cleaned).alias("tokens"))
    return ids_from_tokens(toks, keys, vocab, max_len).select(*keys, F.posexplode("sequences").alias("seq_no", "input_ids"))


def cut_sequences(ids: Column, max_len: int = config.MAX_SEQUENCE_TOKENS) -> Column:
    """array<array<int>>: the ids between start and end marks, at most ``max_len`` with them; one sequence at least."""
    body = max_len - 2
    number = lambda s: F.greatest(F.ceil(F.size(s) / body), F.lit(1)).cast("int")
    return F.transform(F.array(ids), lambda s: F.transform(F.sequence(F.lit(0), number(s) - 1), lambda k: F.concat(
        F.array(F.lit(CLS)), F.slice(s, k * body + 1, F.lit(body)), F.array(F.lit(SEP)))))[0]


def ids_from_tokens(toks: DataFrame, key: str | list[str], vocab: DataFrame | None = None, max_len: int = config.MAX_SEQUENCE_TOKENS,
                    col: str = "tokens") -> DataFrame:
    """(key, sequences array<array<int>>) of every row: every token of the text, in sequences of
    ``max_len`` ids.  A ``__row`` column of a stored table is taken as the row's number."""
    columns = [*_keys(key), *([ROW] if ROW in toks.columns else [])]
    blocks = LX.Blocks(toks, F.col(col), columns, F.size(col) * LETTERS)
    if vocab is None:
        vocab = materialize(_ranked_words(blocks.words()), "vocabulary")

    def make(codes, sizes, values, _) -> dict:
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return {"ids": pa.ListArray.from_arrays(ends, pa.array(values[codes, 0], pa.int32()))}

    ids = blocks.answered(blocks.look_up(vocab, "word", "id", UNK), make, "ids array<int>")
    return ids.select("carried.*", cut_sequences(F.col("ids"), max_len).alias("sequences"))


def pad_batches(ids: DataFrame, key: str | list[str], batch_size: int = config.ENCODER_BATCH_SIZE,
                seed: str = "batch", col: str = "input_ids") -> DataFrame:
    """Pad each sequence to the longest in its batch of ``batch_size`` (batches
    are consecutive runs of a seeded exact rank), with an attention mask.  The
    rank sees keys and lengths only; the ids, stored once, join it at the end by their row."""
    keys = _keys(key)
    ids = materialize(_with_row(ids), "token-ids")
    slim = ids.select(*[F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)], ROW, F.size(col).alias("__n"))
    # equal keys are ranked by their rows' numbers
    r = exact_rank(slim, [], seed, [f"__k_{i}" for i in range(len(keys))], rank_col="__rank", ties=[ROW])
    r = r.select(ROW, "__n", F.floor(F.col("__rank") / batch_size).cast("long").alias("__batch"))
    longest = r.groupBy("__batch").agg(F.max("__n").alias("__max"))
    j = ids.join(r.join(longest, "__batch").drop("__n"), ROW)
    pad = F.col("__max") - F.size(col)
    return j.select(
        *keys, F.col("__batch").alias("batch_id"),
        F.concat(F.col(col), F.array_repeat(F.lit(PAD), pad)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size(col)), F.array_repeat(F.lit(0), pad)).alias("attention_mask"))


def word_bucket(w: Column, dim: int, seed: str = "emb") -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), w)), 1, 8), 16, 10).cast("long"), F.lit(dim))


def embedding(tokens: Column, dim: int, seed: str = "emb") -> Column:
    """F7 (re-aimed): L2-normalised counts of words hashed into ``dim`` buckets
    (all-zero vector without words), inside the row: buckets are sorted and their
    runs counted."""
    buckets = F.sort_array(F.transform(tokens, lambda w: word_bucket(w, dim, seed)))
    counts = F.map_from_entries(_runs(buckets, lambda b: b, lambda b, run: F.struct(b, F.size(run).cast("double"))))
    dense = F.transform(F.array(counts), lambda m: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(m[i.cast("long")], F.lit(0.0))))[0]

    def unit(c: Column) -> Column:
        norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v))
        return F.transform(F.array(norm), lambda n: F.transform(c, lambda v: F.when(n == 0, v).otherwise(v / n)))[0]

    return F.transform(F.array(dense), unit)[0]


def wide_embedding(tokens: Column, dim: int, seed: str = "emb") -> Column:
    """``embedding`` for many dimensions, where a look at every dimension of every row costs too much.  Each distinct word of a batch is hashed once; work and memory follow the words and the vectors."""

    @arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), VECTOR_ROWS):
            some = texts.slice(at, VECTOR_ROWS)
            flat = some.flatten().dictionary_encode()
            bucket = np.array([int(hashlib.md5(f"{seed}|{w}".encode()).hexdigest()[:8], 16) % dim for w in flat.dictionary.to_pylist()], np.int64)
            row = np.repeat(np.arange(len(some)), some.value_lengths().fill_null(0).to_numpy())
            counts = np.bincount(row * dim + bucket[flat.indices.to_numpy()], minlength=len(some) * dim).reshape(len(some), dim).astype(np.float64)
            norm = np.sqrt((counts * counts).sum(1, keepdims=True))
            out.append((counts / np.where(norm > 0, norm, 1)).ravel())
        ends = np.arange(len(texts) + 1, dtype=np.int32) * dim
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else np.zeros(0)))

    return vectors(tokens)


def hashed_embedding(df: DataFrame, key: str | list[str], cleaned: str, dim: int = 64, seed: str = "emb") -> DataFrame:
    return df.select(*_keys(key), embedding(clean_words(cleaned), dim, seed).alias("embedding"))


def clean_track(posts: DataFrame, key: list[str], split_seed: str = str(config.SPLIT_SEED),
                label: int = 0, category: str = "human_written", text: str = "text",
                dim: int = config.EMBEDDING_DIM) -> DataFrame:
    """F8: label, exact split (before cleaning), clean, drop empty cleaned text,
    token ids, hashed embedding -> the ``cleaned_posts`` table.  ``input_ids`` holds the
    text's sequences (one for a text of up to 510 words), ``attention_mask`` theirs."""
    from postloom.operators.sampling import split_exact

    labelled = posts.filter(F.col(text).isNotNull()).withColumn("label", F.lit(label)).withColumn(
        "category", F.lit(category))
    split = split_exact(labelled, key, split_seed)
    # cleaned once per row: the filter sits on an exploded one-element array
    cleaned = split.withColumn("cleaned_text", F.explode(F.filter(F.array(T.clean_text(text)), lambda c: F.length(c) > 0)))
    cleaned = cleaned.withColumn("embedding", wide_embedding(clean_words("cleaned_text"), dim))
    own = [*key, "original_text", "cleaned_text", "label", "category", "split_group", "embedding"]
    path = scratch_path(posts.sparkSession, "clean-track")
    stored = materialize(cleaned.withColumn("original_text", F.col(text)).select(*own), "clean-track", path)
    # the rows travel with the blocks of their texts, packed: they meet their ids there, without a join of whole texts
    out = ids_from_tokens(stored.withColumn("tokens", clean_words("cleaned_text")), own)
    discard(posts.sparkSession, path)
    return out.select(*own[:-1], F.col("sequences").alias("input_ids"),
                      F.transform("sequences", lambda s: F.array_repeat(F.lit(1), F.size(s))).alias("attention_mask"), "embedding")


def model_hook(df: DataFrame, text: str, loader: Callable[[], Callable[[pd.Series], pd.Series]],
               out: str = "score", return_type: str = "double") -> DataFrame:
    """score ``text`` with a caller-supplied model.  ``loader()`` runs once per
    Python worker task (not per row); the returned function scores Arrow batches
    of ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows."""

    @pandas_udf(return_type)
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader()
        for b in batches:
            yield model(b)

    return df.withColumn(out, _score(F.col(text)))

