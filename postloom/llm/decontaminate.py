"""Benchmark decontamination by greedy string tiling.

Method: documents and benchmark items that share a five-word seed are joined; for each such
pair the longest common run of words is marked again and again (runs grow from Karp-Rabin
hashes of five words, marked words are not used twice) until no run of five words is left;
an item is leaked by a document if the tiles cover at least ``COVERAGE`` of its words.
Tiles may come in any order, so reordered passages are caught.

Plan: (1) the benchmark's seeds are hashed and a bit table of at most ``TABLE_BITS`` bits is
built from them; (2) one Arrow map over whole texts keeps the places whose seed the table may
hold, so only these few leave the map; (3) distinct seeds of a document meet the items' rarest
seeds in a hash join.  An item needs ceil(COVERAGE * words / 5) of its seed places, so without
loss only the rarest (places - needed + 1) of them take part: seeds that many items share do
not pair every document with every item; (4) each candidate pair is tiled from its places.
No text is shuffled.  The benchmark side is broadcast up to ``BROADCAST_SEEDS`` rows (it is
counted first) and joined by shuffle beyond.  The table's size is bounded; a larger benchmark
only lets more false places through, which the exact join drops.

Words are lower-cased runs of letters and digits, compared by 64-bit hashes of five.

Edge cases: null or empty text holds nothing; an item of one to four words has one seed, all its
words, and is leaked by each document that holds them in a row; an item without a word matches nothing;
an empty benchmark leaks nowhere.  Rows that share a doc_id are told apart by their text;
equal rows give one result row.  Null ids pass through.  Repeated item ids are told apart by
their text, and the item with the best coverage is reported once per document and id.
Extra columns are ignored by ``leaks`` and kept by ``remove_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.words import Words, cuts, mix, plain_word_chunks, windows
from postloom.session import materialize

SEED = 5
COVERAGE = 0.6
TABLE_BITS = 1 << 26  # at most 8 MB
BROADCAST_SEEDS = 1_000_000
BROADCAST_ROWS = 1_000_000


def _short_windows(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of all runs of ``n`` words, 0 < n < SEED; their hashes differ from seeds'."""
    doc, at, h = windows(words, hashes, n)
    return doc, at, mix(h + np.uint64(n))


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per item: its number of words and its seeds in order (below ``SEED`` words: one of all words)."""
    for batch in batches:
        for i, j, words in plain_word_chunks(batch["text"]):
            h = words.hashes()
            found = [windows(words, h, SEED), *(_short_windows(words, h, n) for n in range(1, SEED))]
            own = [np.ones(len(d), bool) if n == 0 else words.counts()[d] == n for n, (d, _, _) in enumerate(found)]
            doc, h = (np.concatenate([x[c][keep] for x, keep in zip(found, own, strict=True)]) for c in (0, 2))
            by = np.argsort(doc, kind="stable")
            doc, h = doc[by], h[by]
            at = cuts(doc, j - i).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "item_id": batch["item_id"][i:j], "item_tag": batch["item_tag"][i:j], "n_item_words": pa.array(words.counts(), pa.int32()),
                "item_seeds": pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))})


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id, item_tag, n_item_words, item_seeds; items without a word are left out."""
    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = benchmark.select("item_id", F.xxhash64("text").alias("item_tag"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_seed_rows, f"item_id {kind}, item_tag long, n_item_words int, item_seeds array<long>").where(F.size("item_seeds") > 0)


def _table_bits(n_seeds: int) -> int:
    """A power of two: 64 bits for each seed, up to TABLE_BITS."""
    return min(TABLE_BITS, 1 << max(12, (64 * max(1, n_seeds) - 1).bit_length()))


def bit_table(seeds: DataFrame, n_seeds: int) -> np.ndarray:
    """The bit table of a column ``h``; at most TABLE_BITS / 64 rows reach the driver."""
    bits = _table_bits(n_seeds)
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = seeds.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(bits // 64, np.uint64)
    table[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return table


def _keep_hits(table, short: list[int]):
    """``short``: the lengths of the items below ``SEED`` words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = table.value
        mask = np.uint64(len(held) * 64 - 1)
        for batch in batches:
            for i, j, words in plain_word_chunks(batch["text"]):
                hashes, found = words.hashes(), []
                for n in (SEED, *short):
                    doc, at, h = windows(words, hashes, SEED) if n == SEED else _short_windows(words, hashes, n)
                    place = h & mask
                    hit = (held[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                    doc, at, h = doc[hit], at[hit], h[hit]
                    if n != SEED and len(doc):  # one place of each tells that the text holds it
                        by = np.lexsort((at, h, doc))
                        by = by[np.r_[True, (np.diff(doc[by]) != 0) | (h[by][1:] != h[by][:-1])]]
                        doc, at, h = doc[by], at[by], h[by]
                    found.append((doc, at, h))
                doc, at, h = found[0]
                if len(found) > 1:
                    doc, at, h = (np.concatenate([x[c] for x in found]) for c in range(3))
                    by = np.lexsort((at, doc))
                    doc, at, h = doc[by], at[by], h[by]
                if not len(doc):
                    continue
                some = np.unique(doc)
                ends = np.append(np.searchsorted(doc, some), len(doc)).astype(np.int32)
                rows = pa.array(some)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch["doc_id"][i:j].take(rows), "tag": batch["tag"][i:j].take(rows),
                    "places": pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32))),
                    "seeds": pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))})

    return run


def tile(places: np.ndarray, seeds: np.ndarray, item_seeds: np.ndarray) -> tuple[int, int]:
    """Greedy tiling of one pair: (item words covered, tiles).

    ``places`` are ascending word positions of the document with their seed hashes, ``item_seeds``
    the item's in order."""
    order = np.argsort(item_seeds, kind="stable")
    sorted_seeds = item_seeds[order]
    lo, hi = np.searchsorted(sorted_seeds, seeds, "left"), np.searchsorted(sorted_seeds, seeds, "right")
    n = hi - lo
    p = np.repeat(places, n).astype(np.int64)
    q = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    base = int(places[0]) if len(places) else 0
    in_doc = np.zeros(int(places[-1]) - base + SEED if len(places) else 0, bool)
    in_item = np.zeros(len(item_seeds) + SEED - 1, bool)
    by = np.lexsort((p, p - q))  # along diagonals
    p, q = p[by] - base, q[by]
    tiles = 0
    while len(p):
        breaks = np.flatnonzero(np.r_[True, (np.diff(p) != 1) | (np.diff(q) != 1)])
        length = np.diff(np.r_[breaks, len(p)])
        longest = length.max()
        runs = breaks[length == longest]
        for k in runs[np.lexsort((q[runs], p[runs]))]:  # earliest in the document first
            a, b, size = p[k], q[k], longest + SEED - 1
            if not (in_doc[a : a + size].any() or in_item[b : b + size].any()):
                in_doc[a : a + size] = in_item[b : b + size] = True
                tiles += 1
        used_doc, used_item = np.r_[0, np.cumsum(in_doc)], np.r_[0, np.cumsum(in_item)]
        free = (used_doc[p + SEED] == used_doc[p]) & (used_item[q + SEED] == used_item[q])
        p, q = p[free], q[free]
    return int(in_item.sum()), tiles


def _tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [tile(np.asarray(p, np.int64), np.asarray(s, np.int64), np.asarray(t, np.int64)) if n >= SEED else (n, 1) if t[0] in s else (0, 0) for p, s, t, n in zip(
            batch["places"].to_pylist(), batch["seeds"].to_pylist(), batch["item_seeds"].to_pylist(), batch["n_item_words"].to_pylist(), strict=True)]
        covered = np.array([c for c, _ in out], np.int64)
        words = batch["n_item_words"].to_numpy()
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch["doc_id"], "tag": batch["tag"], "item_id": batch["item_id"], "n_tiles": pa.array([t for _, t in out], pa.int32()),
            "n_covered": pa.array(covered, pa.int32()), "n_item_words": batch["n_item_words"], "coverage": pa.array(covered / words, pa.float64())})


def _leaks(docs: DataFrame, benchmark: DataFrame, coverage: float) -> DataFrame:
    items = materialize(benchmark_items(benchmark), "benchmark-items")
    places = items.select("item_id", "item_tag", "n_item_words", F.posexplode("item_seeds").alias("at", "h"))
    frequency = places.groupBy("h").agg(F.countDistinct("item_tag").alias("n_items"))
    needed = F.ceil(F.lit(coverage) * F.col("n_item_words") / SEED).cast("int")
    # an item's places from rare to common; a leak holds one of the first (places - needed + 1)
    ranked = places.join(frequency, "h").groupBy("item_id", "item_tag", "n_item_words").agg(F.sort_array(F.collect_list(F.struct("n_items", "h", "at"))).alias("r"))
    prefix = ranked.select("item_id", "item_tag", F.explode(F.array_distinct(F.transform(
        F.slice("r", F.lit(1), F.greatest(F.lit(1), F.size("r") - needed + 1)), lambda x: x["h"]))).alias("h"))
    prefix = materialize(prefix, "benchmark-seeds")
    about = items.select(F.sum(F.size("item_seeds")).alias("n"), F.collect_set(F.when(F.col("n_item_words") < SEED, F.col("n_item_words"))).alias("short")).first()
    n_seeds = about["n"] or 0
    table = docs.sparkSession.sparkContext.broadcast(bit_table(places.select("h"), n_seeds))
    small = (lambda df: F.broadcast(df)) if n_seeds <= BROADCAST_SEEDS else (lambda df: df)

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("tag"), F.col("text").cast("string").alias("text"))
    hits = materialize(texts.mapInArrow(_keep_hits(table, sorted(about["short"])), f"doc_id {kind}, tag long, places array<int>, seeds array<long>").dropDuplicates(["doc_id", "tag"]), "benchmark-hits")
    keyed = hits.withColumn("row", F.xxhash64("doc_id", "tag"))
    candidates = keyed.select("row", F.explode(F.array_distinct("seeds")).alias("h")).join(small(prefix), "h").select("row", "item_id", "item_tag").distinct()
    pairs = candidates.join(keyed, "row").join(small(items.withColumn("item_key", F.xxhash64("item_id", "item_tag")).drop("item_id", "item_tag")),
                                               F.xxhash64("item_id", "item_tag") == F.col("item_key"))
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    tiled = pairs.select("doc_id", "tag", "item_id", "places", "seeds", "item_seeds", "n_item_words").mapInArrow(
        _tile_rows, f"doc_id {kind}, tag long, item_id {item_kind}, n_tiles int, n_covered int, n_item_words int, coverage double")
    return tiled.where(F.col("coverage") >= coverage)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_tiles, n_covered, n_item_words, coverage for every document that leaks an item."""
    best = _leaks(docs, benchmark, coverage).groupBy("doc_id", "tag", "item_id").agg(
        F.max(F.struct("coverage", "n_covered", "n_item_words", "n_tiles")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_tiles", "b.n_covered", "b.n_item_words", "b.coverage")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    bad = materialize(_leaks(docs, benchmark, coverage).select(F.col("doc_id").alias("_leak_id"), F.col("tag").alias("_leak_tag")).distinct(), "leaked-docs")
    # broadcast only a counted list; beyond, an ordinary anti join
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.join(bad, (F.xxhash64("text") == F.col("_leak_tag")) & F.col("doc_id").eqNullSafe(F.col("_leak_id")), "left_anti")
