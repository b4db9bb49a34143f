import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import near_dedup
from postloom.llm.components import components
from postloom.session import materialize
from postloom.llm.near_dedup import bag_minhash, classes, deduplicate
from postloom.llm.words import mix

from tests.llm.conftest import prose


def bag(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(rows):
    """{(id, text): class} over all pairs at 0.8 or more."""
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both / (sum(bags[i].values()) + sum(bags[j].values()) - both) >= 0.8:
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for k in range(len(rows)):
        members[root(k)].append(k)
    out = []
    for group in members.values():
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        out += [(rows[k][0], min(ids) if ids else None, len(group)) for k in group]
    return sorted(out, key=repr)


def edited(text, share, seed):
    r = random.Random(seed)
    w = text.split()
    for k in r.sample(range(len(w)), max(1, int(len(w) * share))):
        w[k] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def groups():
    rows, n = [], 0
    for g in range(6):
        base = prose(1000 + g, 200)
        texts = [base, base.upper() + "!"] + [edited(base, 0.015 + 0.01 * (k % 5), 10 * g + k) for k in range(12)]
        chain = base
        for k in range(4):  # versions: each near to the last one only
            chain = edited(chain, 0.02, 7000 + 10 * g + k)
            texts.append(chain)
        for t in texts:
            rows.append((n, t))
            n += 1
    return rows + [(500 + k, prose(3000 + k, 120)) for k in range(30)]


def test_signature_is_unbiased():
    r = np.random.default_rng(3)
    for top in (2, 9, 60):
        base, a = r.integers(0, 2**62, 250).astype(np.uint64), r.integers(1, top, 250)
        b = np.where(r.random(250) < 0.7, a, r.integers(0, top, 250))
        have, est = b > 0, []
        for t in range(150):
            e = mix(base + np.uint64(7919 * t))
            s = bag_minhash(np.r_[np.zeros(250, int), np.ones(have.sum(), int)], np.r_[e, e[have]], np.r_[a, b[have]], 2)
            est.append((s[0] == s[1]).mean())
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs(np.mean(est) - true) < 0.013


def test_against_brute_force(spark, groups, rows_of):
    df = spark.createDataFrame(groups, "doc_id long, text string").repartition(6)
    assert rows_of(classes(df)) == brute(groups)


def test_split_groups_and_shuffle_joins_give_the_same(spark, groups, rows_of, monkeypatch):
    monkeypatch.setattr(near_dedup, "GROUP", 3)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame(groups, "doc_id long, text string").repartition(3)
    assert rows_of(classes(df)) == brute(groups)


def test_one_of_each_class_stays(spark, groups):
    df = spark.createDataFrame(groups + [groups[0], groups[0]], "doc_id long, text string")
    kept = [r.doc_id for r in deduplicate(df).collect()]
    assert sorted(kept) == sorted({c for _, c, _ in brute(groups)})


def test_edges(edge_docs, no_docs, clashing_docs, rows_of):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = rows_of(classes(edge_docs))
    assert got == brute(rows)
    assert rows_of(classes(no_docs)) == [] and deduplicate(no_docs).count() == 0
    assert rows_of(classes(clashing_docs)) == got
    kept = deduplicate(clashing_docs)
    assert kept.columns == clashing_docs.columns
    # one row per class: the smallest id of each, and every row without a word
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == sorted([-5, 3, 3, 7, 8, 9, 11, 12, 13, None, None, 4, 5, 6], key=repr)


def test_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)] + [(5, 5)]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_groups_lose_no_pair(spark, rows_of, monkeypatch):
    """Pairs under one template that meet in one bucket only, where no leader is near to them."""
    monkeypatch.setattr(near_dedup, "GROUP", 30)
    rows, template = [], prose(1, 200).split()
    for k in range(120):
        r = random.Random(50 + k)
        own = list(template)
        at = r.sample(range(5, 195, 5), 8)
        for x in at[:5]:
            own[x] = f"own{k}x{x}"
        rows.append((2 * k, " ".join(own)))
        for x in at[5:]:
            own[x] = f"new{k}x{x}"
        rows.append((2 * k + 1, " ".join(own)))
    assert in_one_bucket(spark, rows) == [min(r) for r in brute_ids(rows)]


def test_peripheral_copies_stay_in_their_class(spark):
    """Long chains of versions in one bucket: each is near to its neighbours only, one of them to the leader."""
    rows = []
    for g in range(5):
        text = prose(6000 + g, 150)
        for k in range(30):
            rows.append((100 * g + k, text))
            text = edited(text, 0.014, 80 * g + k)
    assert {n for _, _, n in brute(rows)} == {30}
    assert in_one_bucket(spark, rows) == [min(r) for r in brute_ids(rows)]


def brute_ids(rows):
    """For each row the ids of its class; ids are distinct."""
    label = {i: c for i, c, _ in brute(rows)}
    return [[j for j, _ in rows if label[j] == label[i]] for i, _ in rows]


def in_one_bucket(spark, rows):
    """For each row the smallest id of its class, if all texts share one bucket and no other."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    signed = materialize(near_dedup.signatures(df).withColumn("bands", F.array(F.lit(1).cast("long"))), "signed")
    name = {r.node: r.doc_id for r in signed.collect()}
    label = {name[r.node]: name[r.label] for r in components(near_dedup.links(signed, df)).collect()}
    found = [label.get(i, i) for i, _ in rows]
    return [min(i for (i, _), d in zip(rows, found, strict=True) if d == c) for c in found]
