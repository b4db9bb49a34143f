"""Corpus counts and lookups of the words and word pairs of texts, by blocks of texts.

Texts are cut into blocks of at most ``BLOCK`` words (a longer text is a block of its own).  A block
is numbered inside its task: each text becomes the numbers of its words, and the block's distinct
words, and its distinct pairs of neighbours where asked for, are dealt into hash buckets with their
counts.  A bucket then holds each word or pair once per block, however frequent it is; there the
corpus counts are added up, or a table is met, and each block gets its answers back.  At the end a
block meets its answers and every text its values.

So what is shuffled is one packed piece per block and bucket, never a row per word; a
hot word is one entry per block.  Words are compared by their text, hashes only choose the bucket.
Buckets are counted out by the length of the texts (``CHARS`` a bucket), so none grows with the corpus.

What is stored and shuffled is packed (zstd over the bytes of numbers, place by place, and the letters).  A
block numbers its words bucket by bucket, and the bucket of a pair follows from those of its words, so the
entries of a piece are a run of the block's and no place of an entry is sent, to a bucket or back.  Pieces lie in a
folder of their own, which is deleted as soon as they are answered (``done``).

A pair's key is its two words with a space between: only for words without spaces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.session import discard, materialize, scratch_path, shuffles_released

BLOCK = 1 << 21
CHARS = 1 << 23
# of a block: entries ``first`` to ``first + n``, all of one bucket, words or pairs
PIECE = "block long, bucket int, pair boolean, first int, n int, data binary"
# values of entries, from the column ``slot`` on
ANSWER = "block long, first int, slot int, n int, data binary"
NAMES = [c.split()[0] for c in ANSWER.split(", ")]


def planes(numbers: np.ndarray) -> bytes:
    """The bytes of numbers, all first ones, then all second ones..: the high ones, nearly all 0, then take no room."""
    return numbers.ravel().view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def numbers(data: memoryview, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).ravel().view(kind)


def squeezed(*parts: bytes) -> bytes:
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unsqueezed(data: bytes) -> memoryview:
    return memoryview(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True))


def entries(data: list[bytes], counts: list[int], columns: int = 1) -> tuple[pa.Array, np.ndarray]:
    """The strings of several pieces of so many entries, one after another, and their numbers (entries x columns)."""
    sizes, values, letters = [], [np.zeros((0, columns), np.int64)], []
    for x, n in zip(data, counts, strict=True):
        raw, at = unsqueezed(x), n * 8 * columns
        values.append(numbers(raw[:at], np.int64).reshape(n, columns))
        sizes.append(numbers(raw[at : at + 4 * n], np.int32))
        letters.append(raw[at + 4 * n :])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)]).astype(np.int64) if sizes else np.zeros(1, np.int64)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(b"".join(letters))), np.concatenate(values)


def bucket_hash(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False) if len(words) else np.zeros(0, np.uint64)


def pairs(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (word, next word) of the texts of a block, sorted by number: (first, second, count), and for
    each position that has a next word the place of its pair (the last words of texts have none)."""
    width = int(codes.max()) + 1 if len(codes) else 1
    last = np.zeros(len(codes), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    here = np.flatnonzero(~last)
    found, place, n = np.unique(codes[here].astype(np.int64) * width + codes[here + 1], return_inverse=True, return_counts=True)
    return found // width, found % width, n, place


def pair_bucket(first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a pair from those of its words: the same in every block, and even over the pairs of a hot word."""
    return (first + second) % buckets


def dealt(keys: pa.Array, n: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """(bucket, first, n, data) of the entries of each bucket; entries are sorted by bucket."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else [0]
    _, offsets, letters = keys.buffers() if len(keys) else (None, b"", b"")
    offsets = np.frombuffer(offsets, np.int64)[keys.offset : keys.offset + len(keys) + 1] if len(keys) else np.zeros(1, np.int64)
    sizes, letters = np.diff(offsets).astype(np.int32), memoryview(letters or b"")
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[a]), int(a), int(b - a), squeezed(planes(n[a:b].astype(np.int64)), planes(sizes[a:b]), letters[offsets[a] : offsets[b]])


BLOCKS = f"{PIECE}, sizes binary, carried binary"


def _numbered(with_pairs: bool, buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes = batch["tokens"].value_lengths().fill_null(0).to_numpy()
            carried, total, first = batch["carried"], np.cumsum(sizes, dtype=np.int64), 0
            while first < len(sizes):
                begin = int(total[first] - sizes[first])
                end = max(first + 1, int(np.searchsorted(total, begin + most, "right")))
                flat = batch["tokens"].slice(first, end - first).flatten().cast(pa.large_string()).dictionary_encode()
                words, own = flat.dictionary, sizes[first:end]
                bucket = (bucket_hash(words) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                number = np.empty(len(words), np.int32)
                number[order] = np.arange(len(words), dtype=np.int32)
                codes, words, bucket = number[flat.indices.to_numpy()], words.take(pa.array(order)), bucket[order]
                rows = [(b, False, at, n, x) for b, at, n, x in dealt(words, np.bincount(codes, minlength=len(words)), bucket)]
                if with_pairs:
                    u, w, n, _ = pairs(codes, own)
                    of = pair_bucket(bucket[u], bucket[w], buckets)
                    order = np.argsort(of, kind="stable")
                    u, w = u[order], w[order]
                    key = pc.binary_join_element_wise(words.take(pa.array(u)), words.take(pa.array(w)), pa.scalar(" ", pa.large_string()))
                    rows += [(b, True, len(words) + at, k, x) for b, at, k, x in dealt(key, n[order], of[order])]
                # the block itself: its texts' codes and sizes, words per bucket, and what is carried
                packed = pa.BufferOutputStream()
                with pa.ipc.new_stream(packed, pa.schema([pa.field("carried", carried.type)]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([carried.slice(first, end - first)], ["carried"]))
                rows.append((None, None, None, len(own), squeezed(planes(codes))))
                head = squeezed(planes(np.bincount(bucket, minlength=buckets).astype(np.int32)), planes(own.astype(np.int32)))
                columns, none = list(zip(*rows, strict=True)), [None] * (len(rows) - 1)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(np.full(len(rows), block), pa.int64()), "bucket": pa.array(columns[0], pa.int32()), "pair": pa.array(columns[1], pa.bool_()),
                    "first": pa.array(columns[2], pa.int32()), "n": pa.array(columns[3], pa.int32()), "data": pa.array(columns[4], pa.binary()),
                    "sizes": pa.array([*none, head], pa.binary()), "carried": pa.array([*none, packed.getvalue().to_pybytes()], pa.binary())})
                block, first = block + 1, end

    return run


class Blocks:
    """The numbered texts of ``df`` (stored): ``carried`` is a struct that comes back with each text's values."""

    def __init__(self, df: DataFrame, tokens: Column, carried: list[str], size: Column, with_pairs: bool = False):
        spark = self.spark = df.sparkSession
        with shuffles_released(spark):
            chars = df.agg(F.sum(size)).first()[0] or 0
        self.buckets, self.with_pairs = max(spark.sparkContext.defaultParallelism, -(-int(chars) // CHARS)), with_pairs
        rows = df.select(F.struct(*carried).alias("carried"), tokens.alias("tokens"))
        self.kind = rows.schema["carried"].dataType.simpleString()
        self.path = scratch_path(spark, "text-blocks")
        stored = rows.mapInArrow(_numbered(with_pairs, self.buckets, BLOCK), BLOCKS).withColumn("part", F.when(F.col("bucket").isNull(), "texts").otherwise("pieces"))
        with shuffles_released(spark):  # packed already
            stored.write.partitionBy("part").option("compression", "uncompressed").parquet(self.path)
        read = spark.read.schema(f"{BLOCKS}, part string").option("basePath", self.path).parquet(self.path)
        self.texts = read.where("part = 'texts'").select("block", "n", "data", "sizes", "carried")
        self.pieces = read.where("part = 'pieces'").select(*[c.split()[0] for c in PIECE.split(", ")])

    def done(self) -> None:
        """The pieces are answered, and the answers stored: nothing reads them from here on."""
        discard(self.spark, f"{self.path}/part=pieces")

    def words(self) -> DataFrame:
        """(word, cnt, bucket) of every distinct word of the corpus (without pairs)."""

        def run(t: pa.Table) -> pa.Table:
            keys, n = entries(t["data"].to_pylist(), t["n"].to_pylist())
            keys = keys.dictionary_encode()
            total = np.bincount(keys.indices.to_numpy(), weights=n[:, 0], minlength=len(keys.dictionary)).astype(np.int64)
            return pa.table({"word": keys.dictionary.cast(pa.string()), "cnt": pa.array(total), "bucket": pa.array(np.full(len(total), t["bucket"][0].as_py()), pa.int32())})

        return self.pieces.groupBy("bucket").applyInArrow(run, "word string, cnt long, bucket int")

    def look_up(self, table: DataFrame, word: str, value: str, missing: int) -> DataFrame:
        """Answers: the whole-number ``value`` of each word in ``table`` (a word there once), ``missing`` where there is none."""
        buckets = self.buckets

        def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_pydict({"bucket": pa.array((bucket_hash(b["word"]) % np.uint64(buckets)).astype(np.int32)), "word": b["word"], "value": b["value"]})

        given = table.select(F.col(word).alias("word"), F.col(value).cast("long").alias("value")).where("word is not null")
        given = given.mapInArrow(by_bucket, "bucket int, word string, value long")

        def run(p: pa.Table, t: pa.Table) -> pa.Table:
            known = np.concatenate([[missing], t["value"].to_numpy()])
            own = t["word"].combine_chunks().cast(pa.large_string())
            out = []
            for data, n in zip(p["data"].to_pylist(), p["n"].to_pylist(), strict=True):
                place = pc.index_in(entries([data], [n])[0], value_set=own).fill_null(-1).to_numpy(zero_copy_only=False)
                out.append(known[place + 1].astype(np.int64))
            return answer(p, out)

        return self.pieces.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(run, ANSWER)

    def answered(self, answers: DataFrame, make: Callable, out: str) -> DataFrame:
        """``carried`` and the columns ``out`` of every text: ``make(codes, sizes, values, of_pairs)`` gives them for a block,
        where ``values`` (entries x slots) holds the answers of the words by number, then of the pairs in the order of ``of_pairs`` (``pairs``)."""
        buckets, with_pairs = self.buckets, self.with_pairs

        def run(texts: pa.Table, found: pa.Table) -> pa.Table:
            rows, head = texts["n"][0].as_py(), unsqueezed(texts["sizes"][0].as_py())
            of_bucket, sizes = numbers(head[: 4 * buckets], np.int32), numbers(head[4 * buckets :], np.int32).astype(np.int64)
            codes = numbers(unsqueezed(texts["data"][0].as_py()), np.int32)
            values = np.zeros((0, 1), np.int64)
            if found.num_rows:
                parts = [numbers(unsqueezed(x), np.int64).reshape(n, -1) for x, n in zip(found["data"].to_pylist(), found["n"].to_pylist(), strict=True)]
                first, slot = found["first"].to_numpy(), found["slot"].to_numpy()
                values = np.zeros((max(a + len(x) for a, x in zip(first, parts, strict=True)), max(s + x.shape[1] for s, x in zip(slot, parts, strict=True))), np.int64)
                for a, s, x in zip(first, slot, parts, strict=True):
                    values[a : a + len(x), s : s + x.shape[1]] = x
            of_pairs = None
            if with_pairs:
                of_pairs = pairs(codes, sizes)
                bucket, n_words = np.repeat(np.arange(buckets), of_bucket), int(of_bucket.sum())
                order = np.argsort(pair_bucket(bucket[of_pairs[0]], bucket[of_pairs[1]], buckets), kind="stable")
                values[n_words + order] = values[n_words:].copy()
            carried = pa.ipc.open_stream(texts["carried"][0].as_py()).read_all()["carried"]
            assert len(carried) == rows == len(sizes)
            return pa.table({"carried": carried} | make(codes, sizes, values, of_pairs))

        return self.texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"carried {self.kind}, {out}")


def answer(pieces: pa.Table, values: list[np.ndarray], slot: int = 0, **more: pa.Array) -> pa.Table:
    """A row for each piece, with the values of its entries (one or several columns)."""
    return pa.table({"block": pieces["block"], "first": pieces["first"], "slot": pa.array(np.full(len(values), slot), pa.int32()), "n": pieces["n"],
                     "data": pa.array([squeezed(planes(v)) for v in values], pa.binary()), **more})


def bigram_answers(blocks: Blocks) -> DataFrame:
    """Answers that are the corpus counts of words and pairs, and ``words``: distinct words of a bucket (on one of its rows)."""

    def run(t: pa.Table) -> pa.Table:
        keys, n = entries(t["data"].to_pylist(), t["n"].to_pylist())
        keys = keys.dictionary_encode()
        codes = keys.indices.to_numpy()
        total = np.bincount(codes, weights=n[:, 0], minlength=len(keys.dictionary)).astype(np.int64)
        cuts = np.cumsum(t["n"].to_numpy())[:-1]
        words = len(keys.dictionary) - pc.sum(pc.match_substring(keys.dictionary, " ")).as_py()
        return answer(t, np.split(total[codes], cuts), words=pa.array([words] + [0] * (t.num_rows - 1), pa.int64()))

    return blocks.pieces.groupBy("bucket").applyInArrow(run, f"{ANSWER}, words long")


def mean_of_pairs(sizes: np.ndarray, per_place: np.ndarray) -> np.ndarray:
    """exp of the mean of a text's values, one for each position that has a next word; 0.0 for fewer than two words."""
    n = np.maximum(sizes - 1, 0)
    total = np.bincount(np.repeat(np.arange(len(sizes)), n), weights=per_place, minlength=len(sizes))
    return np.where(n > 0, np.exp(total / np.maximum(n, 1)), 0.0)


def add_one_perplexity(blocks: Blocks) -> DataFrame:
    """``carried`` and perplexity of every text under the add-one bigram model of all of them."""
    answers = materialize(bigram_answers(blocks), "bigram-counts")
    vocabulary = answers.agg(F.sum("words")).first()[0] or 0
    blocks.done()

    def make(codes: np.ndarray, sizes: np.ndarray, values: np.ndarray, of_pairs: tuple) -> dict:
        u, _, _, place = of_pairs
        n_words = int(codes.max()) + 1 if len(codes) else 0
        nll = -np.log((values[n_words:, 0] + 1) / (values[u, 0] + vocabulary))
        return {"perplexity": pa.array(mean_of_pairs(sizes, nll[place]))}

    return blocks.answered(answers.drop("words"), make, "perplexity double")
