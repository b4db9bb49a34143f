"""Filter interaction audit: what five filters remove in each of their 120 orders.

Method: a sparse document-term matrix with globally encoded words; its row sums and numbers of
nonzero entries decide filters A and B, flags that are taken along decide C and D, and a group
over whole texts decides E.  In four steps:

1. Map (Arrow): runs of about ``SHARD_BYTES`` of texts become shards in CSR form, with words
   numbered inside the shard by (hash bucket, first appearance).  A shard is stored once; its
   words leave as one packed row per hash bucket.
2. Shuffle by hash bucket: each bucket gives every distinct word (compared by its bytes, not by
   a hash) one number, ``place in the bucket * buckets + bucket``: the global dictionary.
3. Shuffle by shard: shards meet their words' numbers and become CSR shards over the dictionary
   (``document_term_matrix``).
4. Row sums and nonzero counts per document, joined with E and the labels, end as at most 32
   sets of failed filters per part; every order, step and Shapley sum follows from those.

Bounded memory: a shard is about ``SHARD_BYTES`` of text (or one longer text), a bucket the
distinct words of about ``BUCKET_BYTES`` of text (the number of buckets follows the counted bytes
of the input).  A frequent word reaches its bucket once per shard.  A text that a third of all rows
share is one row per task in the group that decides E, and its rows find their group by broadcast
(``HOT`` groups at most have more than 1 / HOT of all rows; the rest meet by hash).

Edge cases: null or empty text has no word (fails A only, and E after the first).  A null doc_id
is never compared, E needs two known ids, and has no label.  Rows that share a doc_id are judged each; equal ids are
not smaller than each other.  Null and empty source are one part.  Several labels of a doc_id: one
with value 1 is enough.  No rows: no parts.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.words import SPACES, Words, chunks, expand, split_words, squeeze, texts_of
from postloom.session import materialize

SHARD_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20
HOT = 1000
FILTERS = "ABCDE"
FEWEST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 50, 65, 5, "#$%&*|"
ORDERS = ["".join(p) for p in permutations(FILTERS)]

_ROW = "doc_id: bigint, part: string, digest: binary, capitals: boolean, marks: boolean"
SHARD = f"shard long, bucket int, n int, sizes binary, bytes binary, rows array<struct<{_ROW}>>, counted binary, indices binary, counts binary"
MATRIX = f"shard long, rows array<struct<{_ROW}>>, counted binary, indices binary, counts binary"
_ARROW_ROW = pa.struct([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("capitals", pa.bool_()), ("marks", pa.bool_())])
_ARROW_SHARD = pa.schema([("shard", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("sizes", pa.binary()), ("bytes", pa.binary()),
                          ("rows", pa.list_(_ARROW_ROW)), ("counted", pa.binary()), ("indices", pa.binary()), ("counts", pa.binary())])


def _members(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_CAPITALS, _MARKS = _members("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _members(MARKS)
_HEADS = (np.arange(256) & 0xC0) != 0x80  # first bytes of code points


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often a byte flag is set in each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[at])


def _spans(values: pa.Array) -> Words:
    """A binary array's values as spans of one byte array (a text of their own)."""
    data, at = texts_of(values)
    return Words(data, np.array([0, len(data)]), at[:-1], at[1:], np.array([0, len(values)]))


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    wide = ends[-1] >= 1 << 31
    return pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(sizes),
                                 [None, pa.py_buffer(ends.astype(np.int64 if wide else np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _shard(words: Words, n: int) -> tuple[list[dict], dict]:
    """The words of a shard, one row per bucket, and its CSR columns over their numbers."""
    word = _binary(words.data[~SPACES[words.data]], words.end - words.start).dictionary_encode()
    vocabulary = _spans(word.dictionary)
    bucket = _bucket(vocabulary.hashes(), n)
    order = np.argsort(bucket, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    cells, counts = np.unique(words.doc() * max(1, len(order)) + number[word.indices.to_numpy()], return_counts=True)
    row = cells // max(1, len(order))
    sizes = (vocabulary.end - vocabulary.start)[order]
    ordered = word.dictionary.take(pa.array(order))
    data, ends = texts_of(ordered)
    cut = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1], True]) if len(order) else np.zeros(1, np.int64)
    sent = [{"bucket": int(bucket[order[a]]), "n": int(b - a), "sizes": squeeze(sizes[a:b].astype(np.uint32)), "bytes": squeeze(data[ends[a] : ends[b]])}
            for a, b in zip(cut[:-1], cut[1:], strict=True)]
    csr = {"counted": squeeze(np.bincount(row, minlength=len(words.first) - 1).astype(np.uint32)),
           "indices": squeeze((cells - row * max(1, len(order))).astype(np.uint32)), "counts": squeeze(counts.astype(np.uint32))}
    return sent, csr


def _shards(n: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, at = texts_of(batch["text"])
            ids, parts = batch["doc_id"].to_pylist(), batch["part"].to_pylist()
            for i, j in chunks(at, shard_bytes):
                words = split_words(data[at[i] : at[j]], at[i : j + 1] - at[i])
                sent, csr = _shard(words, n)
                where, raw = words.text_at, memoryview(words.data)
                capitals = 100 * _per_text(_CAPITALS[words.data], where) > CAPITAL_PERCENT * _per_text(_HEADS[words.data], where)
                marks = _per_text(_MARKS[words.data], where) > 0
                digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(where[:-1], where[1:], strict=True)]
                rows = [dict(zip(("doc_id", "part", "digest", "capitals", "marks"), r, strict=True))
                        for r in zip(ids[i:j], parts[i:j], digests, capitals.tolist(), marks.tolist(), strict=True)]
                yield pa.RecordBatch.from_pylist([x | {"shard": shard} for x in (*sent, csr | {"bucket": -1, "n": j - i, "rows": rows})], schema=_ARROW_SHARD)
                shard += 1

    return run


_NUMBERS = "shard long, bucket int, n int, sizes binary, bytes binary"
_ARROW_NUMBERS = pa.schema([("shard", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("sizes", pa.binary()), ("bytes", pa.binary())])


def _number(table: pa.Table) -> pa.Table:
    """One bucket: each shard's words as places among the bucket's distinct words (``bytes``), and, with a null
    shard, the distinct words themselves."""
    rows = sorted(table.to_pylist(), key=lambda r: r["shard"])
    sizes = np.concatenate([expand(r["sizes"], np.uint32) for r in rows])
    word = _binary(np.concatenate([expand(r["bytes"], np.uint8) for r in rows]), sizes).dictionary_encode()
    place, ends = word.indices.to_numpy().astype(np.uint32), np.cumsum([0, *[r["n"] for r in rows]])
    out = [{"shard": r["shard"], "bucket": r["bucket"], "n": r["n"], "bytes": squeeze(place[a:b])} for r, a, b in zip(rows, ends[:-1], ends[1:], strict=True)]
    distinct = _spans(word.dictionary)
    out.append({"shard": None, "bucket": rows[0]["bucket"], "n": len(word.dictionary),
                "sizes": squeeze((distinct.end - distinct.start).astype(np.uint32)), "bytes": squeeze(distinct.data)})
    return pa.Table.from_pylist(out, schema=_ARROW_NUMBERS)


def _global(n: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        csr, words = rows[0], rows[1:]  # the shard itself has bucket -1
        number = np.concatenate([np.zeros(0, np.int64), *[expand(r["bytes"], np.uint32).astype(np.int64) * n + r["bucket"] for r in words]])
        return pa.table({"shard": pa.array([csr["shard"]], pa.int64()), "rows": pa.array([csr["rows"]], pa.list_(_ARROW_ROW)),
                         "counted": pa.array([csr["counted"]], pa.binary()),
                         "indices": pa.array([squeeze(number[expand(csr["indices"], np.uint32)])], pa.binary()), "counts": pa.array([csr["counts"]], pa.binary())})

    return run


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            words = _binary(expand(r["bytes"], np.uint8), expand(r["sizes"], np.uint32)).cast(pa.string())
            yield pa.RecordBatch.from_pydict({"word": words, "id": pa.array(np.arange(r["n"], dtype=np.int64) * r["buckets"] + r["bucket"])})


def document_term_matrix(docs: DataFrame, part: Column) -> tuple[DataFrame, DataFrame]:
    """CSR shards of the documents' words, and the dictionary (word, id) of their columns.

    A shard: ``rows`` (doc_id, part, digest of the text, capitals and marks flags) in order, ``counted`` (nonzero entries
    of each row, uint32), ``indices`` (word ids row by row, int64) and ``counts`` (uint32); the last three through
    ``words.squeeze``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.cast("string").alias("part"), F.col("text").cast("string").alias("text"))
    size = texts.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BUCKET_BYTES))
    local = materialize(texts.mapInArrow(_shards(n, SHARD_BYTES), SHARD), "matrix-shards")
    words = local.where("bucket >= 0").select(*[c.split()[0] for c in _NUMBERS.split(", ")])
    numbers = materialize(words.groupBy("bucket").applyInArrow(_number, _NUMBERS), "matrix-words")
    own = local.where("bucket < 0").select("shard", "bucket", "rows", "counted", "indices", "counts", F.lit(None).cast("binary").alias("bytes"))
    met = own.unionByName(numbers.where("shard is not null").select("shard", "bucket", "bytes"), allowMissingColumns=True)
    matrix = met.groupBy("shard").applyInArrow(_global(n), MATRIX)
    dictionary = numbers.where("shard is null").withColumn("buckets", F.lit(n)).mapInArrow(_words_of, "word string, id long")
    return matrix, dictionary


def _row_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, counted, counts in zip(batch["rows"], batch["counted"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            distinct = expand(counted, np.uint32).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(expand(counts, np.uint32), dtype=np.int64)])
            ends = np.concatenate([[0], np.cumsum(distinct)])
            row = rows.values
            yield pa.RecordBatch.from_pydict({c: row.field(c) for c in ("doc_id", "part", "digest", "capitals", "marks")} | {
                "n_words": pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64()), "n_distinct": pa.array(distinct, pa.int64())})


def row_counts(matrix: DataFrame) -> DataFrame:
    """Per document: what its shard took along, n_words (row sum) and n_distinct (nonzero entries)."""
    return matrix.select("rows", "counted", "counts").mapInArrow(
        _row_counts, "doc_id long, part string, digest binary, capitals boolean, marks boolean, n_words long, n_distinct long")


def _with_first(rows: DataFrame) -> DataFrame:
    """``rows`` and the smallest doc_id of each one's text (null where the text is its own)."""
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups, "same-texts")
    total = rows.count()
    hot = groups.where(F.col("n") * HOT > total).select(F.col("digest").alias("hot"), F.col("first").alias("hot_first"))  # HOT rows at most
    near = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot"), "left")
    cold = groups.where(F.col("n") * HOT <= total).select(F.col("digest").alias("cold"), F.col("first").alias("cold_first"))
    left = near.where("hot is null").join(cold, F.col("digest") == F.col("cold"), "left").withColumn("first", F.col("cold_first"))
    done = near.where("hot is not null").withColumn("first", F.col("hot_first"))
    return left.select(*rows.columns, "first").unionByName(done.select(*rows.columns, "first"))


def failed_filters(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part and ``failed`` (bit i: the i-th of ``FILTERS``) for every document."""
    matrix, _ = document_term_matrix(docs, F.coalesce(F.col(part).cast("string"), F.lit("")))
    rows = _with_first(materialize(row_counts(matrix), "audit-rows"))
    conditions = [
        F.col("n_words") < FEWEST_WORDS,
        100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words"),
        F.col("capitals"), F.col("marks"),
        F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))]
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)]
    return rows.select("doc_id", "part", sum(bits[1:], bits[0]).cast("int").alias("failed"))


def audit(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, filter order and step what the step's filter does (see the module's docstring)."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # counted per id first: an id that many rows share is one row in the join
    ids = failed.groupBy("doc_id", "part", "failed").agg(F.count("*").alias("n"))
    joined = ids.join(known, F.col("doc_id") == F.col("id"), "left")
    sums = [F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]]
    cells = joined.groupBy("part", "failed").agg(*sums)
    sets = cells.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("sets"))  # 32 at most
    steps = sets.select("part", "sets", F.explode(F.split(F.lit(",".join(ORDERS)), ",")).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = {c: F.instr("filter_order", F.lit(c)) for c in FILTERS}  # 1 .. 5
    before = sum([F.when(place[c] < F.col("step"), 1 << i).otherwise(0) for i, c in enumerate(FILTERS)], F.lit(0))
    own = sum([F.when(place[c] == F.col("step"), 1 << i).otherwise(0) for i, c in enumerate(FILTERS)], F.lit(0))
    steps = steps.withColumn("before", before).withColumn("own", own)

    def total(value, condition) -> Column:
        return F.aggregate("sets", F.lit(0).cast("long"), lambda a, s: a + F.when(condition(s["failed"]), value(s)).otherwise(0).cast("long"))

    count = lambda s: s["n"]
    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: fails(m) & ~gone(m)
    # a document that fails k filters is removed by each of them in 120 / k of the orders
    return steps.select(
        "part", "filter_order", "step",
        total(count, lambda m: ~gone(m) & ~fails(m)).alias("kept"),
        total(count, removed).alias("removed"),
        total(count, lambda m: fails(m) & gone(m)).alias("redundant"),
        total(count, lambda m: m == F.col("own")).alias("unique_fails"),
        total(lambda s: s["good"], removed).alias("good_lost"),
        total(lambda s: s["toxic"], removed).alias("toxic_lost"),
        total(lambda s: s["n"] * (F.lit(len(ORDERS)) / F.bit_count(s["failed"])).cast("long"), fails).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(failed_filters(docs), labels)
