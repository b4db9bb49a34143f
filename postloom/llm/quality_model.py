"""Quality classifier: a factorisation machine over hashed words, structure and size.

Method: score = sigmoid(b + w.x + 1/2 sum_f ((V x)_f^2 - (V^2 x^2)_f)): all pairwise
interactions of the features through rank-``RANK`` factors, in time linear in the number of
features by the sum-of-squares identity.  Features of a text: its words hashed into
``BUCKETS`` buckets (log counts, unit length), structure statistics (shares of symbols,
digits, capitals, punctuation, line ends, neighbouring equal words, distinct words, mean
word length) and metadata known from the text alone (log sizes).  Labels, lang, source and
doc_id are never features.

Training: at most ``TRAIN_ROWS`` labelled rows with crc32(doc_id as text) mod 5 <> 0, chosen
by a hash of doc_id (a bounded, documented sample; the bound does not depend on the corpus).
Their features - BUCKETS + a few numbers each at most - reach the driver, which fits the
machine with numpy; the model (a few hundred kB) goes to the tasks in a broadcast variable.
Scoring is one Arrow map over whole texts, without shuffle.

Edge cases: null or empty text has only constant features and gets a score.  No labelled
row, or labels of one value only, give the constant score (ones + 1) / (rows + 2).  Several
labels for a doc_id: their majority, 1 on a tie.  A null doc_id counts as held out and is never
trained on.  Rows are kept one to one; ``score`` ignores columns other than doc_id and text,
``keep_good`` returns all columns of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.words import SPACES, Words, word_chunks

BUCKETS = 1 << 13
RANK = 8
TRAIN_ROWS = 6000
EPOCHS = 12
THRESHOLD = 0.3
N_STATS = 13


def _byte_class(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_CLASSES = (_byte_class("#*$%&|<>~^_=+{}[]\\@"), _byte_class("0123456789"), _byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            _byte_class(".,;:!?'\"()-"), _byte_class("!"), _byte_class("\n"))


def features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse word part (text, bucket, value) and the dense structure part (texts x N_STATS)."""
    n_texts = len(words.first) - 1
    n_words = words.counts()
    h = words.hashes()
    doc = words.doc()
    key, count = np.unique(doc * BUCKETS + (h >> np.uint64(40)).astype(np.int64) % BUCKETS, return_counts=True)
    row, bucket = key // BUCKETS, key % BUCKETS
    value = np.log1p(count.astype(np.float64))
    norm = np.sqrt(np.bincount(row, value * value, n_texts))
    value = value / np.maximum(norm, 1e-9)[row]

    size = np.diff(words.text_at)
    some, many = np.maximum(size, 1), np.maximum(n_words, 1)
    stats = np.zeros((n_texts, N_STATS))
    for k, members in enumerate(_CLASSES):
        sums = np.concatenate([[0], np.cumsum(members[words.data], dtype=np.int64)])
        stats[:, k] = np.diff(sums[words.text_at]) / (some if k < 3 else many)
    sums = np.concatenate([[0], np.cumsum(SPACES[words.data], dtype=np.int64)])
    stats[:, 6] = (size - np.diff(sums[words.text_at])) / many / 10  # mean word length
    near = np.concatenate([[0], np.cumsum(np.r_[False, h[1:] == h[:-1]] & np.r_[False, doc[1:] == doc[:-1]])]) if len(h) else np.zeros(1, np.int64)
    stats[:, 7] = np.diff(near[words.first]) / many
    stats[:, 8] = np.bincount(row, minlength=n_texts) / many  # distinct words
    single = np.concatenate([[0], np.cumsum(words.end - words.start == 1)])
    stats[:, 9] = np.diff(single[words.first]) / many
    top = np.zeros(n_texts)
    np.maximum.at(top, row, count)
    stats[:, 10] = top / many
    stats[:, 11] = np.log1p(n_words) / 10
    stats[:, 12] = np.log1p(size) / 10
    return row, bucket, value, stats


@dataclass
class Machine:
    """Feature i < BUCKETS is a word bucket, the others are structure statistics; b is the constant."""

    b: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def raw(self, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and V x of every text."""
        n = len(dense)
        w, v = self.w, self.v
        cut = np.searchsorted(row, np.arange(n + 1))

        def per_text(x: np.ndarray) -> np.ndarray:  # sums over each text's word features
            c = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
            return c[cut[1:]] - c[cut[:-1]]

        vx = per_text(v[bucket] * value[:, None]) + dense @ v[BUCKETS:]
        squares = per_text((v[bucket] * value[:, None]) ** 2) + (dense**2) @ (v[BUCKETS:] ** 2)
        return self.b + per_text(w[bucket] * value) + dense @ w[BUCKETS:] + 0.5 * (vx**2 - squares).sum(1), vx

    def score(self, words: Words) -> np.ndarray:
        row, bucket, value, stats = features(words)
        dense = np.clip((stats - self.mean) / self.scale, -6, 6)
        return 1 / (1 + np.exp(-np.clip(self.raw(row, bucket, value, dense)[0], -40, 40)))


def fit(samples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Adam on the log loss; samples: (buckets, values, structure statistics) of each text."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + N_STATS
    prior = (labels.sum() + 1) / (len(labels) + 2)
    m = Machine(float(np.log(prior / (1 - prior))), np.zeros(size), np.zeros((size, RANK)), np.zeros(N_STATS), np.ones(N_STATS))
    if len(labels) == 0 or labels.min() == labels.max():
        return m
    m.v = rng.normal(0, 0.01, (size, RANK))
    stats = np.stack([s for _, _, s in samples])
    m.mean, m.scale = stats.mean(0), np.maximum(stats.std(0), 1e-3)
    dense_all = np.clip((stats - m.mean) / m.scale, -6, 6)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1), m.w, m.v)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 128):
            pick = order[at : at + 128]
            row = np.repeat(np.arange(len(pick)), [len(samples[i][0]) for i in pick])
            bucket = np.concatenate([samples[i][0] for i in pick])
            value = np.concatenate([samples[i][1] for i in pick])
            dense = dense_all[pick]
            raw, vx = m.raw(row, bucket, value, dense)
            g = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[pick]) / len(pick)
            gw = np.concatenate([np.bincount(bucket, g[row] * value, BUCKETS), dense.T @ g]) + 1e-5 * m.w
            # d score / d v_if = x_i (V x)_f - v_if x_i^2
            part = (g[row] * value)[:, None] * (vx[row] - m.v[bucket] * value[:, None])
            gv = np.zeros((size, RANK))
            for f in range(RANK):
                gv[:BUCKETS, f] = np.bincount(bucket, part[:, f], BUCKETS)
            gv[BUCKETS:] = dense.T @ (g[:, None] * vx) - m.v[BUCKETS:] * ((dense**2).T @ g)[:, None]
            gv += 1e-4 * m.v
            step += 1
            params = (np.array([m.b]), m.w, m.v)
            for p, grad, (first, second) in zip(params, (np.array([g.sum()]), gw, gv), moments, strict=True):
                first += 0.1 * (grad - first)
                second += 0.001 * (grad * grad - second)
                p -= 0.02 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            m.b = float(params[0][0])
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, words in word_chunks(batch["text"]):
            row, bucket, value, stats = features(words)
            cut = np.searchsorted(row, np.arange(j - i + 1))
            yield pa.RecordBatch.from_pydict({
                "label": batch["label"][i:j],
                "buckets": pa.array([bucket[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                "values": pa.array([value[a:b].astype(np.float32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                "stats": pa.array([s.tobytes() for s in stats], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = TRAIN_ROWS) -> Machine:
    """Fits on at most ``rows`` labelled rows that are not held out."""
    known = labels.where(F.col(column).isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").cast("long").alias("id"), F.col(column).cast("double").alias("y"))
    sample = known.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(sample), "id")  # ``rows`` rows of 12 bytes at most
    # repeated doc_ids could pass the bound again: the same limit holds after the join
    joined = joined.orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(rows).select("text", "label")
    got = joined.mapInArrow(_featurize, "label int, buckets binary, values binary, stats binary").collect()
    got.sort(key=lambda r: (bytes(r.stats), bytes(r.buckets)))  # the fit does not depend on the order of arrival
    samples = [(np.frombuffer(r.buckets, np.int32).astype(np.int64), np.frombuffer(r["values"], np.float32).astype(np.float64),
                np.frombuffer(r.stats, np.float64)) for r in got]
    return fit(samples, np.array([float(r.label) for r in got]))


def _scorer(model, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in word_chunks(batch["_quality_text"]):
                out = {c: batch[c][i:j] for c in columns}
                out["_quality_score"] = pa.array(model.value.score(words), pa.float64())
                yield pa.RecordBatch.from_pydict(out)

    return run


def with_score(docs: DataFrame, model: Machine) -> DataFrame:
    """All columns of the documents and ``_quality_score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn("_quality_score", F.lit(0.0)).schema
    return docs.withColumn("_quality_text", F.col("text").cast("string")).mapInArrow(_scorer(sent, docs.columns), schema)


def score(docs: DataFrame, labels: DataFrame, model: Machine | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = model or train(docs, labels)
    kind = docs.schema["doc_id"].dataType
    scored = with_score(docs.select("doc_id", "text").select(F.col("doc_id").cast(kind), F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_quality_score").alias("score"),
                         (F.col("_quality_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, model: Machine | None = None) -> DataFrame:
    """The documents whose score reaches ``THRESHOLD``."""
    model = model or train(docs, labels)
    return with_score(docs, model).where(F.col("_quality_score") >= THRESHOLD).select(*docs.columns)
