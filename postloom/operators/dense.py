"""dense vectors learned from the corpus: a randomised singular value decomposition of the
TF-IDF matrix of hashed words.

The matrix A has a row per text and ``FEATURES`` columns (words by hash); an entry is
(1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), rows have unit length.  Range finder: A' (A X) for a
seeded Gaussian X of dim + ``EXTRA`` columns, made orthonormal, then ``POWER`` power rounds; the Gram
matrix of A in that range gives the right singular vectors and singular values.  A text's vector is
its row times the first ``dim`` right singular vectors.

Plan: the hashed words are stored once; each round is one Arrow map over them in which a task adds
up its own small product, and the products are added in a tree of groups of ``FAN`` (so no task ever
reads more than that many, however many tasks there were).  The driver holds matrices of FEATURES x
(dim + EXTRA) numbers, whatever the corpus.

Texts without words have the zero vector.  Rows are kept one to one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.operators import features as FE
from postloom.session import materialize

FEATURES = 1 << 15
DIM, EXTRA, POWER = 64, 10, 3
FAN = 64
SEED = 42
_BLOCK_ROWS = 4096  # texts that are worked on together
_SLICE = 1024  # entries of the matrix that are multiplied together
_PART_ROWS = 2048  # matrix rows in one piece of a product
_PRODUCT = "id long, part int, data binary"


def hashed(tokens: Column, features: int = FEATURES) -> Column:
    """array<int>: the column of each word."""
    return F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))


def _weighted(columns: pa.Array, idf: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, and of each entry that is not zero its row, feature column, value), by row, for some texts at a time."""
    for i in range(0, len(columns), _BLOCK_ROWS):
        some = columns[i : i + _BLOCK_ROWS]
        n = len(some)
        place = np.repeat(np.arange(n), some.value_lengths().fill_null(0).to_numpy()) * len(idf) + some.flatten().to_numpy()
        place, tf = np.unique(place, return_counts=True)
        row, col = place // len(idf), place % len(idf)
        value = (1 + np.log(tf)) * idf[col]
        norm = np.sqrt(np.bincount(row, weights=value * value, minlength=n))
        yield i, i + n, row, col, value / np.where(norm > 0, norm, 1)[row]


def _add_products(into: np.ndarray, at: np.ndarray, x: np.ndarray, row: np.ndarray, value: np.ndarray) -> None:
    """``into[at] += x[row] * value`` for sorted ``at``, which may repeat: some entries at a time, so that their
    products stay in the processor's cache."""
    for i in range(0, len(at), _SLICE):
        part, here = x[row[i : i + _SLICE]], at[i : i + _SLICE]
        part *= value[i : i + _SLICE, None]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(here)) + 1])
        into[here[starts]] += np.add.reduceat(part, starts, axis=0)


def _times(n: int, row: np.ndarray, col: np.ndarray, value: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``n`` rows times ``x``."""
    y = np.zeros((n, x.shape[1]))
    _add_products(y, row, x, col, value)
    return y


def _sum_products(table: pa.Table, fan: int) -> pa.Table:
    rows = sorted(zip(table["id"].to_pylist(), table["data"].to_pylist(), strict=True))
    total = np.frombuffer(rows[0][1]).copy()
    for _, data in rows[1:]:
        total += np.frombuffer(data)
    return pa.table({"id": pa.array([rows[0][0] // fan], pa.int64()), "part": table["part"][:1].cast(pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})


def _added(products: DataFrame, n: int) -> list[np.ndarray]:
    """The sum of the tasks' products (n tasks at most), part by part."""
    fan = FAN
    while True:
        products = products.groupBy("part", F.floor(F.col("id") / fan).alias("__g")).applyInArrow(lambda t: _sum_products(t, fan), _PRODUCT)
        n = -(-n // fan)
        if n <= 1:
            break
    return [np.frombuffer(bytes(r.data)) for r in products.orderBy("part").collect()]


def _product(rows: DataFrame, sent, gram: bool) -> list[np.ndarray]:
    """A' (A X), or with ``gram`` (A X)' (A X), over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, x = sent.value
        total = np.zeros((x.shape[1], x.shape[1]) if gram else x.shape)
        for batch in batches:
            for i, j, row, col, value in _weighted(batch["columns"], idf):
                y = _times(j - i, row, col, value, x)
                if gram:
                    total += y.T @ y
                else:
                    order = np.argsort(col, kind="stable")
                    _add_products(total, col[order], y, row[order], value[order])
        parts = [total[i : i + _PART_ROWS].tobytes() for i in range(0, len(total), _PART_ROWS)]
        yield pa.RecordBatch.from_pydict({"id": pa.array([TaskContext.get().partitionId()] * len(parts), pa.int64()),
                                          "part": pa.array(range(len(parts)), pa.int32()), "data": pa.array(parts, pa.binary())})

    return _added(rows.select("columns").mapInArrow(run, _PRODUCT), rows.rdd.getNumPartitions())


@dataclass
class Vectors:
    idf: np.ndarray
    right: np.ndarray  # FEATURES x dim
    singular: np.ndarray


def learn(columns: DataFrame, dim: int = DIM, features: int = FEATURES, power: int = POWER, seed: int = SEED) -> Vectors:
    """From a stored table of hashed words (``columns`` array<int>)."""
    spark = columns.sparkSession
    n = columns.count()
    found = columns.select(F.explode(F.array_distinct("columns")).alias("c")).groupBy("c").agg(F.count("*").alias("df")).collect()  # ``features`` at most
    df = np.zeros(features)
    for r in found:
        df[r.c] = r.df
    idf = np.log((1 + n) / (1 + df)) + 1
    width = min(dim + EXTRA, features)
    x = np.random.default_rng(seed).normal(size=(features, width))
    for _ in range(1 + power):
        sent = spark.sparkContext.broadcast((idf, x))
        parts = _product(columns, sent, gram=False)
        sent.unpersist()
        if not parts:
            return Vectors(idf, np.zeros((features, dim)), np.zeros(dim))
        x = np.linalg.qr(np.concatenate(parts).reshape(features, width))[0]
    sent = spark.sparkContext.broadcast((idf, x))
    gram = np.concatenate(_product(columns, sent, gram=True)).reshape(width, width)
    sent.unpersist()
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    top = np.argsort(-value)[:dim]
    right = x @ vector[:, top]
    # of the two signs the one whose largest entry is positive
    sign = np.sign(right[np.abs(right).argmax(0), np.arange(right.shape[1])])
    return Vectors(idf, right * np.where(sign == 0, 1, sign), np.sqrt(np.maximum(value[top], 0)))


def project(rows: DataFrame, vectors: Vectors, col: str = "columns", out: str = "embedding", unit: bool = True) -> DataFrame:
    """``rows`` without ``col``, and each one's vector (of unit length, unless it is zero)."""
    sent = rows.sparkSession.sparkContext.broadcast((vectors.idf, vectors.right))
    kept = [c for c in rows.columns if c != col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, right = sent.value
        for batch in batches:
            y = np.zeros((batch.num_rows, right.shape[1]))
            for i, j, *entries in _weighted(batch[col], idf):
                y[i:j] = _times(j - i, *entries, right)
            if unit:
                norm = np.sqrt((y * y).sum(1, keepdims=True))
                y = y / np.where(norm > 1e-12, norm, 1)
            flat = pa.array(y.astype(np.float32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * right.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in kept} | {out: lists})

    return rows.select(*kept, col).mapInArrow(run, rows.select(*kept, F.array().cast("array<float>").alias(out)).schema)


def svd_embedding(df: DataFrame, key: str | list[str], cleaned: str, dim: int = DIM, features: int = FEATURES) -> DataFrame:
    """the keys of every row and its learned vector."""
    rows = df.select(*FE._keys(key), hashed(FE.clean_words(cleaned), features).alias("columns"))
    # the work is by text, not by byte: as many partitions as any shuffle has
    rows = materialize(rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "hashed-words")
    return project(rows, learn(rows.select("columns"), dim, features))
