import zlib

import numpy as np
import pytest

from postloom.llm.quality_model import BUCKETS, Machine, N_STATS, RANK, fit, keep_good, score, train

SF = "/root/testdata/sf0.01"


def test_linear_time_identity():
    """raw() equals the sum over all feature pairs."""
    r = np.random.default_rng(1)
    size = BUCKETS + N_STATS
    m = Machine(0.3, r.normal(size=size), r.normal(size=(size, RANK)), np.zeros(N_STATS), np.ones(N_STATS))
    rows = [np.sort(r.choice(BUCKETS, 6, replace=False)) for _ in range(3)]
    row, bucket, value, dense = np.repeat([0, 1, 2], 6), np.concatenate(rows), r.normal(size=18), r.normal(size=(3, N_STATS))
    got, _ = m.raw(row, bucket, value, dense)
    for t in range(3):
        x = np.zeros(size)
        x[rows[t]], x[BUCKETS:] = value[row == t], dense[t]
        some = np.flatnonzero(x)
        pairs = sum(m.v[i] @ m.v[j] * x[i] * x[j] for a, i in enumerate(some) for j in some[:a])
        assert got[t] == pytest.approx(m.b + m.w @ x + pairs)


def test_fit_learns_an_interaction():
    """Two buckets that matter only together."""
    r = np.random.default_rng(2)
    a, b = r.random(1500) < 0.5, r.random(1500) < 0.5
    samples = [(np.array([10 + x, 20 + y]), np.full(2, 0.7), np.zeros(N_STATS)) for x, y in zip(a, b, strict=True)]
    m = fit(samples, (a == b).astype(float), epochs=30)
    raw, _ = m.raw(np.repeat(np.arange(1500), 2), np.concatenate([s[0] for s in samples]), np.full(3000, 0.7), np.zeros((1500, N_STATS)))
    assert ((raw > 0) == (a == b)).mean() > 0.95


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in score(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y in truth.items() if got[i].held_out]
    assert len(held) > 40 and sum(p == y for p, y in held) / len(held) >= 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r.doc_id, 1 - r.quality if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.quality) for r in labels.collect()]
    other = train(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
    same = train(docs, labels)
    assert np.array_equal(other.w, same.w) and np.array_equal(other.v, same.v)


def test_edges(spark, edge_docs, no_docs, clashing_docs, rows_of):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 0), (9, 0), (77, 1)], "doc_id long, quality int")
    got = rows_of(score(edge_docs, labels))
    assert len(got) == edge_docs.count() and got == rows_of(score(clashing_docs, labels))
    assert rows_of(score(no_docs, labels)) == []
    none = score(edge_docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    kept = keep_good(clashing_docs, labels.limit(0))
    assert kept.columns == clashing_docs.columns and kept.count() == clashing_docs.count()
