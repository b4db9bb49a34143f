"""MinHash near-dedup: BagMinHash signatures, bands, and verified overlap of shingle multisets.

Method: a text is the multiset of its five-word shingles.  BagMinHash gives each shingle a
Poisson process over (time, weight): the weight axis is cut into the dyadic intervals [0, 1),
[1, 2), [2, 4), [4, 8) ..., each with its own process whose rate is the interval's length and
whose seed is the shingle's hash; points above the shingle's count are thinned out.  A point
falls into one of ``SLOTS`` slots, and each slot keeps its earliest point.  Two texts agree in
a slot with exactly their weighted Jaccard similarity.  Points are drawn only up to the time
at which all slots of the text are likely to be filled (then as far as needed), so a text of n
shingles costs about n + SLOTS * ln(SLOTS) steps instead of n * SLOTS.

Linking: texts with the same words collapse first (pre-aggregation; a group of exact copies
is one row from there on).  ``BANDS`` bands of ``ROWS`` slots make buckets; a pair at 0.8 shares a
bucket with probability 0.99993.  In each bucket all members are compared with one leader,
the member that meets most others in all its buckets; so a group of copies costs one
comparison per member and bucket, not one per pair.  One round of star links labels what common
leaders connect; then, in each bucket, all members that still have different labels are compared with each other,
whether linked to the leader or not (inside tasks, each pair in the first bucket it shares, by
signature, then by multiset, and only while the two are not yet connected).  So each pair that
shares a bucket is verified, ruled out by signature, or already connected.  More than ``GROUP``
members of such a bucket are dealt into blocks that meet each other in tasks of their own, so no
task holds a large group and no pair is lost.  A link is made only if the multiset overlap shows
a weighted Jaccard similarity of ``SIMILARITY`` or more.  Components of the links are the classes.

What leaves the first map is a signature row per text; texts are read again only for members
of buckets.  That list is counted: up to ``BROADCAST_ROWS`` it is broadcast as a filter, beyond
it is joined by shuffle.  All stages are written to the shared checkpoint folder.

Words are lower-cased runs of letters and digits.  Nodes are 64-bit hashes of a text's words.

Edge cases: null texts and texts without a word are each a class of their own.  Texts of one
to four words have one shingle, all their words.  Rows that share a doc_id are told apart by
their text.  class_id is the smallest doc_id of the class (nulls aside; null if all are).
``deduplicate`` keeps one row of each class: smallest doc_id, then a hash of the text; of rows
equal in doc_id and text one stays.  A null doc_id comes after all others.  Extra columns are
ignored by ``classes`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.components import components
from postloom.llm.words import Words, cuts, mix, plain_word_chunks, windows
from postloom.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
SLOTS = BANDS * ROWS
GROUP = 1000
BROADCAST_ROWS = 1_000_000
_GOLD = 0x9E3779B97F4A7C15
_LOOKS = 0.12  # more than three standard deviations of the signature's estimate at 0.8


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle occurrence; a short text has one of all its words."""
    h = words.hashes()
    doc, _, s = windows(words, h, SHINGLE)
    n = words.counts()
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        whole = np.array([_sequence(h[words.first[d] : words.first[d + 1]], 0x51ED) for d in short], np.uint64)
        doc, s = np.concatenate([doc, short]), np.concatenate([s, whole])
    return doc, s


def _sequence(hashes: np.ndarray, seed: int) -> np.uint64:
    """Hash of a sequence of word hashes."""
    with np.errstate(over="ignore"):
        place = mix(np.arange(1, len(hashes) + 1, dtype=np.uint64) * np.uint64(_GOLD) + np.uint64(seed))
        return mix(np.array([np.add.reduce(mix(hashes ^ place)) + np.uint64(len(hashes))], np.uint64))[0]


def sequences(words: Words, hashes: np.ndarray, seed: int) -> np.ndarray:
    """``_sequence`` of each text's words."""
    n = words.counts()
    at = np.arange(len(hashes), dtype=np.uint64) - np.repeat(words.first[:-1], n).astype(np.uint64)
    place = mix((at + np.uint64(1)) * np.uint64(_GOLD) + np.uint64(seed))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ place), dtype=np.uint64)])
    return mix(sums[words.first[1:]] - sums[words.first[:-1]] + n.astype(np.uint64))


def bag_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """(n_docs x SLOTS) earliest times; elements are distinct within a text, weights are counts of 1 or more.

    Texts without an element keep infinity."""
    levels = 1 + np.ceil(np.log2(weight)).astype(np.int64)  # dyadic intervals below the weight
    of = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(of)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    rate = np.where(level > 0, low, 1.0)
    text, w = doc[of], weight[of].astype(np.float64)
    seed = mix(element[of] + level.astype(np.uint64) * np.uint64(_GOLD))
    time, step = np.zeros(len(of)), np.zeros(len(of), np.uint64)
    out = np.full(n_docs * SLOTS, np.inf)
    total = np.bincount(doc, weight, n_docs)
    limit = (math.log(SLOTS) + 3) / np.maximum(total, 1.0)
    # the next point of each process: exponential gaps, all slots together
    def advance(k: np.ndarray) -> None:
        step[k] += np.uint64(1)
        u = ((mix(seed[k] + step[k] * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time[k] -= np.log(u) / (rate[k] * SLOTS)

    live = np.arange(len(of))
    advance(live)
    while len(live):
        now = live[time[live] <= limit[text[live]]]
        while len(now):
            point = mix(seed[now] ^ mix(step[now] + np.uint64(0x2545F4914F6CDD1D)))
            slot = (point >> np.uint64(32)).astype(np.int64) % SLOTS
            height = low[now] + (point & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate[now]
            inside = height < w[now]
            np.minimum.at(out, text[now[inside]] * SLOTS + slot[inside], time[now[inside]])
            advance(now)
            now = now[time[now] <= limit[text[now]]]
        missing = np.isinf(out.reshape(n_docs, SLOTS)).any(1)
        limit = np.where(missing, limit * 2, -1.0)
        live = live[missing[text[live]]]
    return out.reshape(n_docs, SLOTS)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, words in plain_word_chunks(batch["text"]):
            n = j - i
            h = words.hashes()
            doc, s = shingles(words)
            by = np.lexsort((s, doc))
            doc, s = doc[by], s[by]
            new = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])]) if len(s) else np.zeros(0, np.int64)
            count = np.diff(np.r_[new, len(s)])
            times = bag_minhash(doc[new], s[new], count, n)
            values = mix(times.view(np.uint64))
            parts = values.reshape(n, BANDS, ROWS)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * np.uint64(_GOLD), (n, BANDS)).copy()
            for r in range(ROWS):
                key = mix(key ^ parts[:, :, r]) + np.uint64(r)
            some = words.counts() > 0
            at = np.r_[0, np.cumsum(np.where(some, BANDS, 0))].astype(np.int32)
            short = np.ascontiguousarray(values.astype(np.uint16))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"][i:j], "tag": batch["tag"][i:j],
                "node": pa.array(sequences(words, h, 1).view(np.int64), mask=~some), "check": pa.array(sequences(words, h, 2).view(np.int64)),
                "bands": pa.ListArray.from_arrays(pa.array(at), pa.array(key[some].ravel().view(np.int64))),
                "signature": pa.array([short[d].tobytes() for d in range(n)], pa.binary())})


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, tag, node (null without words), check, bands array<long>, signature (SLOTS x 16 bits)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_sign, "doc_id long, tag long, node long, check long, bands array<long>, signature binary")


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's sorted shingle hashes, repeated as often as they occur (32 bits each)."""
    for batch in batches:
        for i, j, words in plain_word_chunks(batch["text"]):
            doc, s = shingles(words)
            s = (s >> np.uint64(32)).astype(np.uint32)
            by = np.lexsort((s, doc))
            at, s = cuts(doc[by], j - i), s[by]
            yield pa.RecordBatch.from_pydict({"node": batch["node"][i:j], "bag": pa.array([s[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())})


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two sorted multisets of 32-bit hashes."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not len(x) or not len(y) or min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return 0.0
    both = np.concatenate([x, y])
    side = np.r_[np.zeros(len(x), np.int8), np.ones(len(y), np.int8)]
    by = np.argsort(both, kind="stable")
    both, side = both[by], side[by]
    head = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
    in_y = np.add.reduceat(side.astype(np.int64), head)
    in_all = np.diff(np.r_[head, len(both)])
    common = np.minimum(in_y, in_all - in_y).sum()
    return float(common / (len(x) + len(y) - common))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = [overlap(a, b) >= SIMILARITY for a, b in zip(batch["bag_a"].to_pylist(), batch["bag_b"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"a": batch["a"], "b": batch["b"], "linked": pa.array(linked, pa.bool_())})


def _alike(table: pa.Table) -> np.ndarray:
    """Pairs of rows of one piece whose signatures may belong to linked texts, most alike first: not those of
    one label, and those that share more buckets only in the first of them (which the bands tell before any
    signature is read)."""
    signature = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(-1, SLOTS)
    side, label, bucket = (table[c].to_numpy() for c in ("side", "label", "bucket"))
    bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    earlier = int((bands[0] == bucket[0]).argmax())  # the bands before this bucket's
    x, y = np.ascontiguousarray(bands[left, :earlier].T), np.ascontiguousarray(bands[right, :earlier].T)
    slots, others = np.ascontiguousarray(signature[left].T), np.ascontiguousarray(signature[right].T)
    out, block, least = [np.zeros((0, 3), np.int64)], max(1, (1 << 18) // max(1, len(right))), (SIMILARITY - _LOOKS) * SLOTS
    for i in range(0, len(left), block):
        own = left[i : i + block]
        open_ = (label[own, None] != label[right]) & ((side[own, None] != 2) | (own[:, None] < right))  # a block with itself: each pair once
        for k in range(earlier):
            open_ &= x[k, i : i + block, None] != y[k]
        a, b = np.nonzero(open_)
        if len(a) * 4 < open_.size:
            same = np.concatenate([(signature[own[a[k : k + 20000]]] == signature[right[b[k : k + 20000]]]).sum(1) for k in range(0, len(a), 20000)] or [a])
        else:
            dense = np.zeros(open_.shape, np.uint8)
            for k in range(SLOTS):
                dense += slots[k, i : i + block, None] == others[k]
            same = dense[a, b].astype(np.int64)
        some = same >= least
        out.append(np.stack([same[some], own[a[some]], right[b[some]]], 1))
    pairs = np.concatenate(out)
    return pairs[np.argsort(-pairs[:, 0], kind="stable"), 1:]


def _partners(table: pa.Table) -> pa.Table:
    """Members of one piece that have a partner by signature."""
    return table.take(pa.array(np.unique(_alike(table))))


def _connect(table: pa.Table) -> pa.Table:
    """Links inside one piece: multisets are compared only while the two are not connected yet."""
    bags, node = table["bag"].to_pylist(), table["node"].to_numpy()
    _, first, which = np.unique(table["label"].to_numpy(), return_index=True, return_inverse=True)
    parent = first[which].tolist()  # what has one label is connected

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i, j in _alike(table).tolist():
        a, b = root(i), root(j)
        if a != b and overlap(bags[i], bags[j]) >= SIMILARITY:
            parent[a] = b
            links.append((node[i], node[j]))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


PIECE = "bucket long, left int, right int, side int, node long, label long, bands array<long>, signature binary"


def _pieces(members: DataFrame) -> DataFrame:
    """(bucket, left, right, side, node, label) of all members (bucket, node, label) of buckets with more than one label.

    Groups of ``GROUP`` members at most stay whole.  A larger one is dealt into blocks of half that size,
    the members of its most frequent label apart from the others; each block of the others meets
    itself and all blocks in pieces of their own, so every pair of different labels meets in one piece.
    ``side``: 0 left block, 1 right block, 2 a block with itself."""
    labels = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = labels.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("n_labels"))
    sized = materialize(members.join(mixed.where("n_labels > 1"), "bucket"), "groups")
    half, small, other = max(1, GROUP // 2), F.col("n") <= GROUP, F.col("label") != F.col("most.label")
    others, most = F.ceil((F.col("n") - F.col("most.n")) / half), F.ceil(F.col("most.n") / half)
    hashed = F.xxhash64("node")
    own = F.when(small, 0).when(other, F.pmod(hashed, others)).otherwise(others + F.pmod(hashed, most)).cast("int")
    last = (F.when(small, 1).when(other, others + most).otherwise(others) - 1).cast("int")
    dealt = sized.select("bucket", "node", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("met"))
    return dealt.select(
        "bucket", F.least("own", "met").alias("left"), F.greatest("own", "met").alias("right"),
        F.when(F.col("own") == F.col("met"), 2).when(F.col("own") < F.col("met"), 0).otherwise(1).alias("side"), "node", "label")


def links(signed: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified links (a, b) between nodes; ``signed``: stored result of ``signatures(docs)``."""
    nodes = signed.where("node is not null").groupBy("node").agg(F.first("bands").alias("bands"), F.first("signature").alias("signature"),
                                                                F.min(F.struct("doc_id", "tag")).alias("doc"))
    nodes = materialize(nodes, "nodes")
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    size = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(banded.join(size, "bucket"), "buckets")
    meets = members.groupBy("node").agg(F.sum("n").alias("meets"))
    ranked = members.join(meets, "node")
    leader = ranked.groupBy("bucket").agg(F.max(F.struct("meets", "node"))["node"].alias("leader"))
    starred = members.join(leader, "bucket").where("node <> leader").select("bucket", "node", "leader")
    starred = materialize(starred, "stars")

    # read the texts of bucket members again, for their multisets
    wanted = nodes.select("node", "doc").join(meets.select("node"), "node", "left_semi").select(
        "node", F.col("doc.doc_id").alias("want_id"), F.col("doc.tag").alias("want_tag"))
    wanted = materialize(wanted, "bucket-members")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.col("text").cast("string").alias("text"))
    found = texts.join(wanted, (F.col("tag") == F.col("want_tag")) & F.col("doc_id").eqNullSafe(F.col("want_id")))
    bags = found.select("node", "text").mapInArrow(_bags, "node long, bag binary")
    bags = materialize(bags.groupBy("node").agg(F.first("bag").alias("bag")), "bags")

    a, b = bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
    pairs = starred.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    judged = materialize(pairs.join(a, "a").join(b, "b").select("a", "b", "bag_a", "bag_b").mapInArrow(_verify, "a long, b long, linked boolean"), "judged")

    # what the leaders left apart: in each bucket, members that no common leader connects are compared
    linked = judged.where("linked").select("a", "b")
    stars = materialize(components(linked, rounds=1), "star-labels")
    labelled = starred.select("bucket", "node").join(stars, "node", "left").withColumn("label", F.coalesce("label", "node"))
    pieces = _pieces(labelled).join(nodes.select("node", "bands", "signature"), "node").select(*[c.split()[0] for c in PIECE.split(", ")])
    partners = materialize(pieces.groupBy("bucket", "left", "right").applyInArrow(_partners, PIECE), "partners")
    connected = partners.join(bags, "node").groupBy("bucket", "left", "right").applyInArrow(_connect, "a long, b long")
    return linked.union(connected)


def _labelled(docs: DataFrame) -> DataFrame:
    """doc_id, tag, node, label (a node; null without words)."""
    signed = materialize(signatures(docs), "signatures")
    found = components(links(signed, docs))
    label = found.select("node", "label")
    return signed.select("doc_id", "tag", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size for every row."""
    rows = materialize(_labelled(docs), "labelled")
    some = rows.where("label is not null")
    # stored, so that the join below is one of two plain exchanges, which a large class may split
    named = materialize(some.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "classes")
    out = some.join(named, "label").select("doc_id", "class_id", "class_size")
    return out.union(rows.where("label is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns."""
    rows = materialize(_labelled(docs), "labelled")
    some = rows.where("label is not null")
    first = materialize(some.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag")).alias("first")), "classes")
    copies = some.join(first, "label").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tag") == F.col("first.tag"))))
    gone = materialize(copies.select(F.col("doc_id").alias("_copy_id"), F.col("tag").alias("_copy_tag")).distinct(), "copies")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    left = docs.join(gone, (F.xxhash64("text") == F.col("_copy_tag")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_copy_id")), "left_anti")
    # rows equal in doc_id and text: only such repeated ones are compared further
    twice = some.groupBy("doc_id", "tag").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_copy_id"), F.col("tag").alias("_copy_tag"))
    twice = materialize(twice, "repeated-rows")
    if twice.isEmpty():
        return left
    twice_ = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    same = (F.xxhash64("text") == F.col("_copy_tag")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_copy_id"))
    repeated = left.join(twice_, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice_, same, "left_anti").unionByName(repeated)
