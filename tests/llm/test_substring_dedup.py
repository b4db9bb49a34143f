import hashlib
import re

from postloom.llm.substring_dedup import removal_intervals, substring_dedup  # noqa: F401

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, size):
    """Rows sharing doc_id and text are one document; null ids come first."""
    docs = {}
    for i, t in rows:
        docs.setdefault((i, t or ""), WORD.findall(t or ""))
    first = {}
    for (i, t), w in docs.items():
        key = (i is not None, i or 0)
        for s in range(len(w) - size + 1):
            g = tuple(w[s : s + size])
            first.setdefault(g, []).append((key, t, s))
    out = {}
    for (i, t), w in docs.items():
        key, gone = (i is not None, i or 0), set()
        for s in range(len(w) - size + 1):
            seen = first[tuple(w[s : s + size])]
            if any(k < key or k == key and u == t and p < s for k, u, p in seen):
                gone |= set(range(s, s + size))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out[i, t] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def unique_ids(rows):
    seen, out = set(), []
    for i, t in rows:
        if i not in seen:
            seen.add(i)
            out.append((i, t))
    return out


def test_against_brute_force(spark, edge_docs):
    rows = unique_ids([(r.doc_id, r.text) for r in edge_docs.collect()])
    for size in (20, 3):
        want = brute(rows, size)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in substring_dedup(df, size).collect()}
        assert got == {i: v for (i, _), v in want.items()}


def test_rows_that_share_an_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (2, "other " * 3)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in substring_dedup(df).collect())
    assert got == [(1, 0), (1, 0), (2, 0), (2, 30)]


def test_every_row_of_hot_copies(spark):
    text = " ".join(f"w{i}" for i in range(25))
    df = spark.range(400).selectExpr("id AS doc_id", f"'{text}' AS text").repartition(16)
    got = {r.doc_id: r.n_removed for r in substring_dedup(df, with_text=False).collect()}
    assert got == {0: 0} | {i: 25 for i in range(1, 400)}


def test_edges(edge_docs, no_docs, clashing_docs, rows_of):
    assert rows_of(substring_dedup(no_docs)) == []
    assert rows_of(substring_dedup(clashing_docs)) == rows_of(substring_dedup(edge_docs))
    assert substring_dedup(edge_docs).count() == edge_docs.count()
