"""Hard-negative mining: angular triangle filtering before exact integer scores.

Method: vectors become integers (floor of 256 times each component).  Every row stores its norm
and its angles to ``REFERENCES`` reference directions.  For an anchor with angles p_j and a row
with angles t_j the triangle inequality on the sphere gives

    max_j |t_j - p_j|  <=  angle(anchor, row)  <=  min_j min(t_j + p_j, 2 pi - t_j - p_j),

so the cosine lies in an interval, and times both norms, widened by ``SLACK`` of their product and
one, the integer score lies between two integers whatever the rounding.  A row is scored only
where these bounds overlap what is still wanted:

1. Positives: rows of the anchor's label whose upper bound reaches its ``POSITIVES``-th best score
   so far.
2. Negatives: rows of other labels whose bounds overlap one of the anchor's windows
   ``LOW`` <= 100 * score / positive_score <= ``HIGH`` and that can still enter its best ``NEGATIVES``.

Plan: the table is stored once with norms and angles.  The anchors (a stated query set against all
rows) are dealt by hash into blocks of about ``ANCHOR_BYTES``; each block goes to all tasks in a
broadcast variable of that size and meets the rows where they lie, in Arrow batches.  A task keeps
the best few rows of each anchor, a window with ``row_number`` keeps the best of all tasks.  Rows
are never shuffled by label, so a hot label or vector makes no hot task.  The driver holds one
block of anchors at a time and a sample of ``SAMPLE`` rows from which the directions are taken
(farthest first, by angle); which directions are taken changes the work, never the result.

Edge cases: rows with a null vec_id, label or vector, or with a null or non-finite component, take
no part.  Of rows that share a vec_id one takes part: smallest label, then smallest vector.
Vectors of unequal length are compared as if the shorter ended in zeros; an all-zero or empty
vector scores 0 with all.  Components saturate at 2^31; scores are exact where they fit a long.
An anchor without positives, or a positive whose window holds no row, returns nothing.  Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.session import materialize

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score
REFERENCES = 16
SAMPLE = 4096
ANCHOR_BYTES = 16 << 20
SLACK = 1e-6  # of the norms' product: above the error of angles from double cosines
_SAME_LABEL, _LABELS = 7, 10  # every 7th row's label moves on by one of 10
ANCHOR_EVERY = 50
_ROWS = 2048  # rows compared with a block of anchors at a time
VECTOR = "vec_id long, label long, vector binary, norm double, angles binary"


def moved_label() -> Column:
    return F.when(F.col("vec_id") % _SAME_LABEL == 0, (F.col("label") + 1) % _LABELS).otherwise(F.col("label"))


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, embedding (doubles) of the rows that take part, one per vec_id."""
    x = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    limit = F.lit(float("inf"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (v < limit) & (v > -limit))
    x = x.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    one = x.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r"))
    return one.select("vec_id", F.col("r.label").alias("label"), F.col("r.embedding").alias("embedding"))


def quantized(column: pa.Array) -> list[np.ndarray]:
    """floor(256 * x) of each vector as int64."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    q = np.clip(np.floor(256.0 * flat), -(2.0**31), 2.0**31).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    return [q[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """Stored vectors as rows of ``width`` components, zeros after a shorter one's end."""
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        q = np.frombuffer(v, np.int64)[:width]
        out[k, : len(q)] = q
    return out


def _angles(q: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = q.astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    cosine = (x @ directions.T) / np.maximum(norm, 1e-300)[:, None]
    return norm, np.arccos(np.clip(cosine, -1, 1))


def directions_of(sample: list[bytes]) -> np.ndarray:
    """Unit vectors, each the sampled one farthest (by angle) from those before it."""
    width = max((len(v) // 8 for v in sample), default=0)
    x = matrix(sample, width).astype(np.float64)
    x = x[(x * x).sum(1) > 0]
    if not len(x):
        return np.zeros((0, width))
    x /= np.sqrt((x * x).sum(1))[:, None]
    mean = x.mean(0)
    chosen = [int(np.argmax(x @ mean))]
    nearest = x @ x[chosen[0]]
    while len(chosen) < min(REFERENCES, len(x)) and nearest.min() < 1 - 1e-9:
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]


def _store(directions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = directions.value
        for batch in batches:
            vectors = batch["vector"].to_pylist()
            norm, angle = np.zeros(len(vectors)), np.zeros((len(vectors), len(r)))
            for i in range(0, len(vectors), _ROWS):
                some = vectors[i : i + _ROWS]
                width = max(r.shape[1], max(len(v) // 8 for v in some))
                wide = np.zeros((len(r), width))
                wide[:, : r.shape[1]] = r  # what lies beyond the directions' length counts in the norm
                norm[i : i + _ROWS], angle[i : i + _ROWS] = _angles(matrix(some, width), wide)
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in ("vec_id", "label", "vector")} | {
                "norm": pa.array(norm), "angles": pa.array([a.tobytes() for a in angle], pa.binary())})

    return run


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"vec_id": batch["vec_id"], "label": batch["label"],
                                          "vector": pa.array([q.tobytes() for q in quantized(batch["embedding"])], pa.binary())})


def with_angles(rows: DataFrame) -> DataFrame:
    """The stored table: vec_id, label, vector (int64 components), norm, angles to the directions."""
    spark = rows.sparkSession
    q = materialize(usable(rows).mapInArrow(_integers, "vec_id long, label long, vector binary"), "integer-vectors")
    sample = q.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").collect()
    directions = spark.sparkContext.broadcast(directions_of([bytes(r.vector) for r in sample]))
    return materialize(q.mapInArrow(_store(directions), VECTOR), "angles")


@dataclass
class Anchors:
    """One block of anchors, and for each the scores wanted (positives' scores, or none yet)."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    angles: np.ndarray
    wanted: list[list[tuple[int, int]]]  # (positive_id, positive_score) of each anchor

    @classmethod
    def of(cls, rows: list) -> Anchors:
        vectors = [bytes(r.vector) for r in rows]
        width = max((len(v) // 8 for v in vectors), default=0)
        return cls(np.array([r.vec_id for r in rows], np.int64), np.array([r.label for r in rows], np.int64), matrix(vectors, width),
                   np.array([r.norm for r in rows]), np.stack([np.frombuffer(bytes(r.angles), np.float64) for r in rows]),
                   [[(p.positive_id, p.positive_score) for p in r.wanted] for r in rows])


def bounds(norm: float, angle: np.ndarray, norms: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest integer score that one vector may have with each row."""
    product = norm * norms
    if angles.shape[1]:
        near = np.abs(angles - angle).max(1)
        both = angles + angle
        far = np.minimum(both, 2 * np.pi - both).min(1)
        low, high = np.cos(np.maximum(far, near)), np.cos(near)
    else:
        low, high = -1.0, 1.0
    room = SLACK * product + 1
    return np.floor(product * low - room), np.ceil(product * high + room)


def scores(vectors: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    width = min(vectors.shape[1], len(anchor))
    x, a = vectors[:, :width], anchor[:width]
    if width and float(np.abs(x).max(initial=0)) * float(np.abs(a).max(initial=0)) * width < 2.0**53:
        return (x.astype(np.float64) @ a.astype(np.float64)).astype(np.int64)  # every partial sum is an exact integer
    return x @ a


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(vec_id, label, vectors, norms, angles) of some rows at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            b = batch.slice(i, _ROWS)
            raw = b["vector"].to_pylist()
            yield (b["vec_id"].to_numpy(), b["label"].to_numpy(), matrix(raw, max(len(v) // 8 for v in raw)), b["norm"].to_numpy(),
                   np.stack([np.frombuffer(a, np.float64) for a in b["angles"].to_pylist()]))


class _Best:
    """The best ``size`` (score, then smaller id) seen so far."""

    def __init__(self, size: int):
        self.size, self.score, self.id = size, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> float:
        return self.score[-1] if len(self.score) == self.size else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.r_[self.score, score], np.r_[self.id, ids]
        if len(score) > 8 * self.size:  # only what reaches the last place
            last = np.partition(score, len(score) - self.size)[len(score) - self.size]
            score, ids = score[score >= last], ids[score >= last]
        by = np.lexsort((ids, -score))[: self.size]
        self.score, self.id = score[by], ids[by]


_FOUND = "anchor_id long, positive_id long, positive_score long, id long, score long"


def _found(entries: list[tuple[int, int | None, int | None, _Best]]) -> pa.RecordBatch:
    n = [len(b.id) for *_, b in entries]
    repeated = lambda k: pa.array([e[k] for e, m in zip(entries, n, strict=True) for _ in range(m)], pa.int64())
    joined = lambda xs: pa.array(np.concatenate([np.zeros(0, np.int64), *xs]), pa.int64())
    return pa.RecordBatch.from_pydict({"anchor_id": repeated(0), "positive_id": repeated(1), "positive_score": repeated(2),
                                       "id": joined([b.id for *_, b in entries]), "score": joined([b.score for *_, b in entries])})


def _positives(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Anchors = block.value
        best = [_Best(POSITIVES) for _ in a.ids]
        for ids, labels, vectors, norms, angles in _blocks(batches):
            for label in np.unique(labels):
                rows = np.flatnonzero(labels == label)
                for k in np.flatnonzero(a.labels == label):
                    _, high = bounds(a.norms[k], a.angles[k], norms[rows], angles[rows])
                    some = rows[(high >= best[k].floor()) & (ids[rows] != a.ids[k])]
                    if len(some):
                        best[k].add(scores(vectors[some], a.vectors[k]), ids[some])
        yield _found([(int(i), None, None, b) for i, b in zip(a.ids, best, strict=True)])

    return run


def _negatives(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Anchors = block.value
        best = [[_Best(NEGATIVES) for _ in w] for w in a.wanted]
        # integer windows; one of a negative positive score is empty
        windows = [[(-(-LOW * p // 100), HIGH * p // 100) for _, p in w] for w in a.wanted]
        for ids, labels, vectors, norms, angles in _blocks(batches):
            for k in range(len(a.ids)):
                open_ = [(lo, hi, b) for (lo, hi), b in zip(windows[k], best[k], strict=True) if lo <= hi]
                if not open_:
                    continue
                low, high = bounds(a.norms[k], a.angles[k], norms, angles)
                wanted = np.zeros(len(ids), bool)
                for lo, hi, b in open_:
                    wanted |= (low <= hi) & (high >= max(lo, b.floor()))
                some = np.flatnonzero(wanted & (labels != a.labels[k]))
                if len(some):
                    score = scores(vectors[some], a.vectors[k])
                    for lo, hi, b in open_:
                        inside = (score >= max(lo, b.floor())) & (score <= hi)
                        if inside.any():
                            b.add(score[inside], ids[some[inside]])
        yield _found([(int(i), p, s, b) for i, w, bs in zip(a.ids, a.wanted, best, strict=True) for (p, s), b in zip(w, bs, strict=True)])

    return run


def _each_block(rows: DataFrame, anchors: DataFrame, n: int, task) -> DataFrame:
    """What ``task`` finds for each block of anchors, stored block by block."""
    spark = rows.sparkSession
    out = None
    for k in range(n):
        block = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == k).collect()  # about ANCHOR_BYTES
        if not block:
            continue
        block.sort(key=lambda r: r.vec_id)
        sent = spark.sparkContext.broadcast(Anchors.of(block))
        found = materialize(rows.mapInArrow(task(sent), _FOUND), "found")
        sent.unpersist()
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], _FOUND) if out is None else out


def _ranked(found: DataFrame, by: list[str], n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= n)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = with_angles(embeddings.withColumn("label", moved_label()))
    anchors = rows.where(F.col("vec_id") % ANCHOR_EVERY == 0)
    size = anchors.select(F.sum(F.octet_length("vector") + F.octet_length("angles"))).first()[0] or 0
    n = max(1, -(-size // ANCHOR_BYTES))
    kind = "array<struct<positive_id: bigint, positive_score: bigint>>"
    found = _each_block(rows, anchors.withColumn("wanted", F.array().cast(kind)), n, _positives)
    positives = _ranked(found, ["anchor_id"], POSITIVES).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    positives = materialize(positives, "positives")
    wanted = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("wanted"))  # POSITIVES at most
    asked = materialize(anchors.join(wanted, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"), "asked")
    found = _each_block(rows, asked, n, _negatives)
    return _ranked(found, ["anchor_id", "positive_id"], NEGATIVES).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
