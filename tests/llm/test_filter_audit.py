import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from postloom.llm import filter_audit as FA
from postloom.llm.words import expand

WORD = re.compile("[^\x20\x09-\x0d]+")
LABELS = "doc_id long, quality int, toxic int"


def failed(rows):
    """(doc_id, part, set of failed filters) of every row, the plain way."""
    firsts = {}
    for i, t, _ in rows:
        if i is not None:
            firsts[t or ""] = min(firsts.get(t or "", i), i)
    out = []
    for i, t, source in rows:
        t = t or ""
        w = WORD.findall(t)
        bad = {"A"} if len(w) < 50 else set()
        bad |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        bad |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        bad |= {"D"} if set(t) & set("#$%&*|") else set()
        bad |= {"E"} if i is not None and i > firsts[t] else set()
        out.append((i, source or "", bad))
    return out


def brute(rows, labels):
    judged = failed(rows)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {p for _, p, _ in judged}:
        here = [(i, b) for i, p, b in judged if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = here
            for step, f in enumerate(order, 1):
                gone = [(i, b) for i, b in left if f in b]
                before = set(order[: step - 1])
                left = [(i, b) for i, b in left if f not in b]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in b and bool(b & before) for _, b in here), sum(b == {f} for _, b in here),
                                                   sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f]
        for key in [k for k in out if k[0] == part]:
            out[key][6] = shapley[out[key][6]]
    return sorted((*k, *v) for k, v in out.items())


def run(spark, docs, labels):
    got = FA.filter_audit(docs, spark.createDataFrame(labels, LABELS))
    return sorted(tuple(r) for r in got.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def test_edges_against_brute_force(spark, edge_docs, clashing_docs):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, 1, 1), (None, 1, 1), (12, 0, 1), (12, 0, 1), (99, 1, 1)]
    rows = [(r.doc_id, r.text, r.source) for r in edge_docs.collect()]
    assert run(spark, edge_docs, labels) == brute(rows, labels)
    assert run(spark, clashing_docs, labels) == brute(rows, labels)
    parted = edge_docs.withColumn("source", F.element_at(F.array(F.lit("x"), F.lit(None), F.lit(""), F.lit("é")), (F.length(F.coalesce("text", F.lit(""))) % 4 + 1).cast("int")))
    rows = [(r.doc_id, r.text, r.source) for r in parted.collect()]
    assert run(spark, parted, labels) == brute(rows, labels)


def test_no_rows(spark, no_docs, edge_docs):
    assert run(spark, no_docs, [(1, 1, 1)]) == []
    assert {r[7] for r in run(spark, edge_docs, [])} == {0}


@pytest.mark.parametrize("hot", [1, 1000])
def test_many_shards_and_a_hot_text(spark, monkeypatch, hot):
    monkeypatch.setattr(FA, "SHARD_BYTES", 300)
    monkeypatch.setattr(FA, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(FA, "HOT", hot)  # every repeated text by hash, or by broadcast
    rows = [(i, ("same words here " * 20 + "Z#") if i % 3 == 0 else f"w{i} " * (i % 7) + " ".join(f"v{(i * k) % 57}" for k in range(i % 90)), f"s{i % 2}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 400, 3)]
    assert run(spark, docs, labels) == brute(rows, labels)


def test_matrix_equals_the_counts_of_words(spark, edge_docs, monkeypatch):
    import numpy as np

    monkeypatch.setattr(FA, "SHARD_BYTES", 2000)
    monkeypatch.setattr(FA, "BUCKET_BYTES", 20000)
    matrix, dictionary = FA.document_term_matrix(edge_docs.repartition(4), F.lit("p"))
    word = {r.id: r.word for r in dictionary.collect()}
    rows = edge_docs.collect()
    assert len(word) == dictionary.count() == len({w for r in rows for w in WORD.findall(r.text or "")})
    got = []
    for shard in matrix.collect():
        counted, indices, counts = expand(shard.counted, np.uint32), expand(shard.indices, np.int64), expand(shard.counts, np.uint32)
        at = np.cumsum([0, *counted.tolist()])
        for k, r in enumerate(shard.rows):
            got.append((r.doc_id, sorted((word[i], int(c)) for i, c in zip(indices[at[k] : at[k + 1]].tolist(), counts[at[k] : at[k + 1]], strict=True))))
    want = []
    for r in rows:
        words = WORD.findall(r.text or "")
        want.append((r.doc_id, sorted((w, words.count(w)) for w in set(words))))
    assert sorted(got, key=repr) == sorted(want, key=repr)
