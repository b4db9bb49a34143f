import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import language_id as LI

SF = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def model(spark):
    return LI.train(LI.training_rows(spark.read.parquet(SF)))


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_words_by_script():
    data, at = arrays(["Ab, c1d", "", "Привет мир", "日本語text ÄÖ", "é éx ...", "नमस्ते दुनिया", "́ ́"])
    w = LI.words_of(data, at)
    name = lambda k: "".join(map(chr, w.cps[w.first[k] : w.first[k + 1]]))
    got = [(int(w.doc[k]), int(w.begin[k]), name(k), LI.SCRIPT_NAMES[w.script[k]], int(w.letters[k])) for k in range(len(w.doc))]
    assert got == [(0, 0, "ab", "latin", 2), (0, 4, "c", "latin", 1), (0, 6, "d", "latin", 1), (2, 0, "привет", "cyrillic", 6), (2, 7, "мир", "cyrillic", 3),
                   (3, 0, "日本語", "han", 3), (3, 3, "text", "latin", 4), (3, 8, "äö", "latin", 2), (4, 0, "é", "latin", 1), (4, 2, "éx", "latin", 2),
                   (5, 0, "नमस्ते", "devanagari", 4), (5, 7, "दुनिया", "devanagari", 3)]


def plain_viterbi(scores, prior, penalty):
    value, back = list(prior), []
    for k, s in enumerate(scores):
        if k:
            top = max(range(len(value)), key=lambda x: (value[x], -x))
            back.append([x if value[x] >= value[top] - penalty else top for x in range(len(value))])
            value = [max(v, value[top] - penalty) for v in value]
        value = [v + x for v, x in zip(value, s, strict=True)]
    path = [max(range(len(value)), key=lambda x: (value[x], -x))]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def test_viterbi_against_the_plain_form():
    r = np.random.default_rng(5)
    for labels in (1, 2, 5):
        size = [0, 7, 1, 30, 7, 0, 2, 200]
        doc = np.repeat(np.arange(len(size)), size)
        scores = -r.integers(0, 9, (40, labels)).astype(float)  # ties are common
        which, prior = r.integers(0, 40, len(doc)), -r.integers(0, 3, labels).astype(float)
        got = LI.viterbi(scores, which, doc, len(size), prior, 4.0)
        for d in range(len(size)):
            if size[d]:
                assert got[doc == d].tolist() == plain_viterbi(scores[which[doc == d]].tolist(), prior.tolist(), 4.0)


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(SF)
    lang = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = LI.identify(docs, model).collect()
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    judged = [r for r in got if r.held_out and any(c.isalpha() for c in lang[r.doc_id][1] or "")]
    assert len(judged) > 150
    assert np.mean([r.lang_pred == lang[r.doc_id][0] for r in judged]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_only_rows_in_training_are_counted(spark, model):
    changed = spark.read.parquet(SF).withColumn("lang", F.when(LI.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    again = LI.train(LI.training_rows(changed))
    assert again.languages == model.languages and (again.logs == model.logs).all()


def test_model_equals_counts_of_features(spark):
    docs = spark.createDataFrame([(0, "Ab ab b", "x"), (1, "ab", "y"), (3, "мир", "y"), (4, None, "z"), (5, "12", "z")], "doc_id long, text string, lang string")
    m = LI.train(docs.repartition(3))
    assert sorted(m.languages) == ["x", "y"]
    x = m.languages.index("x")
    word = LI.words_of(*arrays(["ab"]))
    feature, _ = word.features(np.array([0]), word.hashes())
    # x: "ab" twice and "b" once: 5 trigrams (2 + 2 + 1) and 3 words
    n_tri = 2 + LI.ALPHA
    assert np.allclose(m.logs[feature[0], x], np.log(n_tri / (5 + LI.ALPHA * LI.BUCKETS)))
    assert np.allclose(m.logs[feature[-1], x], np.log((2 + LI.ALPHA) / (3 + LI.ALPHA * LI.BUCKETS)))
    assert m.writes[:, LI.SCRIPT_NAMES.index("cyrillic")].tolist() == [name == "y" for name in m.languages]


def test_spans_of_mixed_texts(spark, model):
    r = random.Random(4)
    texts = {}
    for row in spark.read.parquet(SF).where(F.length("text").between(400, 2000)).where(LI.held_out(F.col("doc_id"))).orderBy("doc_id").collect():
        texts.setdefault(row.lang, []).append(" ".join(row.text.split()))
    rows, truth = [], {}
    for k in range(60):
        a, b = r.sample(sorted(texts), 2)
        first, second = r.choice(texts[a]), r.choice(texts[b])
        rows.append((k, first + " " + second))
        truth[k] = (a, b, len(first))
    right = total = 0
    for row in LI.label_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), model).collect():
        a, b, cut = truth[row.doc_id]
        for s in row.spans:
            at = [s.start <= c < s.end and c for c in range(s.start, s.end)]
            right += sum(s.lang == (a if c < cut else b) for c in at if c is not False)
            total += len(at)
        assert row.n_spans == len(row.spans)
    assert right / total > 0.95


def test_scripts_narrow_candidates(spark):
    docs = spark.createDataFrame([(0, "привет мир друг", "ru"), (1, "hello world friend", "en"), (3, "bonjour monde ami", "fr")] * 3, "doc_id long, text string, lang string")
    m = LI.train(docs)
    got = {r.doc_id: r for r in LI.label_spans(spark.createDataFrame([(0, "миру мир"), (1, "friend of the world"), (2, "друг friend"), (3, "漢字"), (4, "1 2 3"), (5, None)],
                                                                     "doc_id long, text string"), m).collect()}
    assert [got[k].lang_pred for k in range(6)] == ["ru", "en", "en", m.languages[0], "und", "und"]
    assert got[0].score == 1.0 and got[4].score == got[5].score == 0.0 and got[4].spans == []
    assert got[3].score == pytest.approx(1 / 3, rel=0.01)


def test_edges(spark, edge_docs, no_docs, clashing_docs, rows_of):
    got = rows_of(LI.identify(edge_docs))
    assert len(got) == edge_docs.count() and got == rows_of(LI.identify(clashing_docs))
    by_text = {(r[0], r[2]) for r in got}
    assert (4, "und") in by_text and (5, "und") in by_text and (6, "und") in by_text and (9, "en") in by_text
    assert all(r[1] for r in got if r[0] is None)
    assert rows_of(LI.identify(no_docs)) == []
    nothing = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r[2], r[3]) for r in rows_of(LI.identify(nothing))} == {("und", 0.0)}
