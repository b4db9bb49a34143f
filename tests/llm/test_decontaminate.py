import random
import re

import pytest

from postloom.llm.decontaminate import leaks, remove_leaks

from tests.llm.conftest import prose


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute_tiles(doc, item, least=5):
    a, b = words(doc), words(item)
    ma, mb, tiles = [False] * len(a), [False] * len(b), 0
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best:
                    best, found = k, []
                if k == best and k >= least:
                    found.append((i, j))
        if not found:
            return sum(mb), tiles
        for i, j in found:
            if not any(ma[i : i + best]) and not any(mb[j : j + best]):
                ma[i : i + best], mb[j : j + best] = [True] * best, [True] * best
                tiles += 1


@pytest.fixture(scope="module")
def case(spark):
    r = random.Random(5)
    items = [(k, prose(100 + k, 20 + k)) for k in range(12)] + [(12, "too few words"), (13, None), (14, ""), (None, prose(140, 30)), (15, "same words " * 12)]
    docs = [(k, prose(200 + k, 60)) for k in range(10)]
    for k in range(12):
        w = items[k][1].split()
        h = len(w) // 2
        docs.append((20 + k, prose(300 + k, 30) + " " + " ".join(w) + " " + prose(400 + k, 10)))  # whole
        docs.append((40 + k, " ".join(w[h:]).upper() + "! " + prose(500 + k, 20) + " -- " + ", ".join(w[:h])))  # halves swapped
        docs.append((60 + k, prose(600 + k, 30) + " " + " ".join(w[: len(w) // 3])))  # a third
    docs += [(90, prose(140, 30)), (91, "same words " * 40), (None, items[3][1]), (92, None), (93, ""), (20, docs[10][1])]
    r.shuffle(docs)
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(case):
    docs, items, d, b = case
    want = set()
    for i, t in docs:
        for k, u in items:
            covered, tiles = brute_tiles(t, u)
            if len(words(u)) >= 5 and covered >= 0.6 * len(words(u)):
                want.add((i, k, covered, len(words(u))))
    got = [(r.doc_id, r.item_id, r.n_covered, r.n_item_words) for r in leaks(d, b).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {20 + k for k in range(12)} | {40 + k for k in range(12)} | {90} <= {r[0] for r in got}
    assert not {60 + k for k in range(12)} & {r[0] for r in got}


def test_shuffle_joins_give_the_same(case, monkeypatch, rows_of):
    from postloom.llm import decontaminate

    _, _, d, b = case
    want, kept = rows_of(leaks(d, b)), rows_of(remove_leaks(d, b))
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate, "TABLE_BITS", 1 << 12)
    assert rows_of(leaks(d, b)) == want and rows_of(remove_leaks(d, b)) == kept


def test_removal_keeps_the_rest(case):
    docs, _, d, b = case
    bad = {r.doc_id for r in leaks(d, b).collect()}
    kept = [r.doc_id for r in remove_leaks(d, b).collect()]
    assert sorted(map(repr, kept)) == sorted(repr(i) for i, t in docs if i not in bad)


def test_edges(spark, edge_docs, no_docs, clashing_docs, rows_of):
    b = spark.createDataFrame([(1, prose(1, 80), "x"), (1, prose(1, 80), "y"), (2, None, None)], "item_id long, text string, doc_id string")
    assert rows_of(leaks(no_docs, b)) == [] and rows_of(leaks(edge_docs, b.limit(0))) == []
    got = rows_of(leaks(edge_docs, b))
    assert rows_of(leaks(clashing_docs, b)) == got
    assert {r[0] for r in got} == {1, 2, None, 11, -5} and len(got) == 5
    assert remove_leaks(clashing_docs, b).columns == clashing_docs.columns
    assert remove_leaks(edge_docs, b.limit(0)).count() == edge_docs.count()


def test_items_shorter_than_a_seed(spark, rows_of):
    """An item of one to four words leaks where its words stand in a row."""
    items = [(1, "Forty-two"), (2, "yes"), (3, "the blue whale swims"), (4, "..."), (5, prose(7, 20)), (6, "no such thing")]
    docs = [(10, "It said: forty two! And FORTY two."), (11, "two forty"), (12, "oh yes"), (13, prose(7, 20) + " the blue whale, swims"),
            (14, "the blue"), (15, "the blue fat whale swims"), (16, "Yes"), (17, ""), (18, None), (19, "yesterday " * 9)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(10, 1, 1, 2, 2, 1.0), (12, 2, 1, 1, 1, 1.0), (16, 2, 1, 1, 1, 1.0), (13, 3, 1, 4, 4, 1.0), (13, 5, 1, 20, 20, 1.0)], key=repr)
    assert rows_of(leaks(d, b)) == want
    assert sorted(r.doc_id for r in remove_leaks(d, b).collect()) == [11, 14, 15, 17, 18, 19]
