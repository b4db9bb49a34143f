"""Substring dedup: words covered by a window of 20 words that starts earlier elsewhere go.

Method: Rabin-Karp hashes of every window, counted in Spark; the windows that are not
the first of their kind merge into maximal removal intervals.

Plan, in four Spark steps:

1. Map (Arrow): rolling hashes of all windows of about 2 MB of texts at a time.  Windows
   that repeat inside such a run are settled on the spot (pre-aggregation: only the
   first of each kind goes on), the others leave as one packed row per hash bucket.
2. Shuffle by hash bucket; each bucket finds the first (doc_id, start) of every hash and
   sends on the places of all later ones, packed by document bucket.
3. Shuffle by document bucket: starts become maximal intervals, one row per document.
4. Left join with the documents; a last Arrow map cuts the words and hashes the rest.

Bounded memory: a bucket holds 1 / (2 * spark.sql.shuffle.partitions) of the windows, so
the setting that sizes any other shuffle sizes these.  A window shared by a third of all
rows reaches its bucket once per 2 MB run of texts at most.  Windows are compared by their
hash: 56 stored bits and the bucket's, about 63 in all.

Edge cases: null or empty text has no words (n_words 0, hash of the empty string).  A null
doc_id counts as the smallest.  Rows that share a doc_id are told apart by their text; equal
rows are one document and all return its result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.words import expand, mix, squeeze, texts_of, chunks, split_words, windows, word_chunks

WINDOW = 20
RUN_BYTES = 2 << 20  # texts whose windows are settled together before the shuffle
NULL_ID = -(1 << 63)
_SENT = "bucket int, docs binary, tags binary, counts binary, starts binary, hashes binary"


def _pack(bucket: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, hashes: np.ndarray | None,
          shift: int = 0) -> Iterator[dict]:
    """One row per bucket; entries ordered by (document, start), documents and starts as differences."""
    order = np.argsort(bucket, kind="stable")
    bucket, doc, tag, start = bucket[order], doc[order], tag[order], start[order]
    hashes = None if hashes is None else hashes[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        d, t, s = doc[a:b], tag[a:b], start[a:b]
        at = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
        step = np.diff(s, prepend=0)
        step[at] = s[at]
        with np.errstate(over="ignore"):
            ids = np.diff(d[at], prepend=np.int64(0))
        yield {"bucket": int(bucket[a]) + shift, "docs": squeeze(ids), "tags": t[at].astype(np.uint16).tobytes(),
               "counts": squeeze(np.diff(np.r_[at, b - a]).astype(np.uint32)), "starts": squeeze(step.astype(np.uint32)),
               "hashes": b"" if hashes is None else np.ascontiguousarray(
                   hashes[a:b].view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()}


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    counts = expand(row["counts"], np.uint32).astype(np.int64)
    with np.errstate(over="ignore"):
        doc = np.repeat(np.cumsum(expand(row["docs"], np.int64)), counts)
    tag = np.repeat(np.frombuffer(row["tags"], np.uint16), counts)
    sums = np.cumsum(expand(row["starts"], np.uint32).astype(np.int64))
    first = np.cumsum(counts) - counts
    before = np.where(first > 0, sums[first - 1], 0)  # the differences restart with each document
    start = sums - np.repeat(before, counts)
    if not row["hashes"]:
        return doc, tag, start, None
    wide = np.zeros((len(doc), 8), np.uint8)
    wide[:, :7] = np.frombuffer(row["hashes"], np.uint8).reshape(-1, 7)
    return doc, tag, start, wide.view(np.uint64).ravel()


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _doc_bucket(doc: np.ndarray, tag: np.ndarray, n: int) -> np.ndarray:
    return _bucket(mix(doc.view(np.uint64) ^ (tag.astype(np.uint64) << np.uint64(47))), n)


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_ARROW_SENT = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in ("docs", "tags", "counts", "starts", "hashes")])


def _map_windows(size: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.lexsort((batch["tag"].to_numpy(), batch["key"].to_numpy()))
            batch = batch.take(pa.array(order))
            keys, tags = batch["key"].to_numpy(), batch["tag"].to_numpy().astype(np.int64)
            for i, j, words in word_chunks(batch["text"], RUN_BYTES):
                doc, start, h = windows(words, words.hashes(), size)
                if not len(h):
                    continue
                doc_id, tag = keys[i:j][doc], tags[i:j][doc]
                by = np.argsort(h, kind="stable")
                same = np.r_[False, h[by][1:] == h[by][:-1]]
                first = np.flatnonzero(~same)
                lead = by[first[np.cumsum(~same) - 1]]  # the first of its kind, for each in order
                later = same & ((doc_id[by] != doc_id[lead]) | (tag[by] != tag[lead]) | (start[by] != start[lead]))
                go = np.zeros(len(h), bool)
                go[by[later]] = True
                keep = np.ones(len(h), bool)
                keep[by[same]] = False
                rows = list(_pack(_bucket(h[keep], n), doc_id[keep], tag[keep], start[keep], h[keep]))
                if go.any():  # settled here: they pass through the same shuffle with their document bucket, without hash
                    rows += _pack(_doc_bucket(doc_id[go], tag[go], n), doc_id[go], tag[go], start[go], None)
                yield _table(rows, _ARROW_SENT)

    return run


def _reduce_windows(n: int):
    def run(table: pa.Table) -> pa.Table:
        out, parts = [], []
        for row in table.to_pylist():
            if row["hashes"]:
                parts.append(_unpack(row))
            else:
                out.append(row)
        if parts:
            doc, tag, start, h = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            by = np.argsort(h, kind="stable")
            h = h[by]
            equal = h[1:] == h[:-1]
            some = np.r_[equal, False] | np.r_[False, equal]
            by, h = by[some], h[some]  # only hashes that several runs of texts hold
            doc, tag, start = doc[by], tag[by], start[by]
            by = np.lexsort((start, tag, doc, h))
            doc, tag, start, h = doc[by], tag[by], start[by], h[by]
            new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (doc != doc[lead]) | (tag != tag[lead]) | (start != start[lead])
            doc, tag, start = doc[later], tag[later], start[later]
            by = np.lexsort((start, tag, doc))
            doc, tag, start = doc[by], tag[by], start[by]
            out += _pack(_doc_bucket(doc, tag, n), doc, tag, start, None)
        return pa.Table.from_pylist(out, schema=_ARROW_SENT)

    return run


def _intervals(size: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(row)[:3] for row in table.to_pylist()]
        doc, tag, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.lexsort((start, tag, doc))
        doc, tag, start = doc[by], tag[by], start[by]
        new_doc = np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]
        open_ = new_doc | np.r_[True, start[1:] > start[:-1] + size]
        at = np.flatnonzero(open_)
        last = np.r_[at[1:], len(start)] - 1
        lo, hi = start[at], start[last] + size
        runs = np.stack([lo, hi], 1).astype(np.int32)
        heads = np.flatnonzero(new_doc[at])
        tails = np.r_[heads[1:], len(at)]
        return pa.table({"key": pa.array(doc[at][heads], pa.int64()), "tag": pa.array(tag[at][heads].astype(np.int32), pa.int32()),
                         "runs": pa.array([runs[a:b].tobytes() for a, b in zip(heads, tails, strict=True)], pa.binary())})

    return run


def removal_intervals(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(key, tag, runs): per document with removals its maximal [first word, end word) intervals, int32 pairs."""
    n = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.select("key", "tag", "text").mapInArrow(_map_windows(size, n), _SENT)
    later = sent.groupBy("bucket").applyInArrow(_reduce_windows(n), _SENT)
    return later.groupBy("bucket").applyInArrow(_intervals(size), "key long, tag int, runs binary")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = texts_of(batch["text"])
        for i, j in chunks(at):
            words = split_words(data[at[i] : at[j]].copy(), at[i : j + 1] - at[i])
            n, first = len(words.start), words.first
            gone = np.zeros(n + 1, np.int64)
            for d, runs in enumerate(batch["runs"][i:j].to_pylist()):
                if runs:
                    r = np.frombuffer(runs, np.int32).reshape(-1, 2) + first[d]
                    gone[r[:, 0]] += 1
                    gone[r[:, 1]] -= 1
            kept = np.cumsum(gone[:n]) == 0
            # of each text: the bytes of kept words, and one space after each but the last
            edge = np.zeros(len(words.data) + 1, np.int8)
            np.add.at(edge, words.start[kept], 1)
            np.add.at(edge, words.end[kept], -1)
            mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
            n_kept = np.concatenate([[0], np.cumsum(kept)])[first]
            nth = np.flatnonzero(kept)
            inner = np.ones(len(nth), bool)
            inner[n_kept[1:][np.diff(n_kept) > 0] - 1] = False
            gaps = words.end[nth[inner]]
            words.data[gaps] = 0x20
            mask[gaps] = True
            size = np.concatenate([[0], np.cumsum(mask)])[words.text_at]
            out = words.data[mask].tobytes()
            total = words.counts()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"][i:j], "n_words": pa.array(total, pa.int64()),
                "n_removed": pa.array(total - np.diff(n_kept), pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(out[a:b]).hexdigest() for a, b in zip(size[:-1], size[1:], strict=True)], pa.string()),
                "kept_text": pa.array([out[a:b].decode() for a, b in zip(size[:-1], size[1:], strict=True)], pa.string())})


def _cut_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        yield batch.drop_columns(["kept_text"])


def substring_dedup(docs: DataFrame, size: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text."""
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key"),
        F.xxhash64("text").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("tag"), F.col("text").cast("string").alias("text"))
    joined = keyed.join(removal_intervals(keyed, size), ["key", "tag"], "left").select("doc_id", "text", "runs")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return joined.mapInArrow(_cut, schema + ", kept_text string") if with_text else joined.mapInArrow(_cut_digest, schema)
