import re
from collections import Counter

from postloom.llm.quality_rules import BASE_MASK, POLICIES, RULES, ablation, apply_policy, ledger, quality_rules

from tests.llm.conftest import prose

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    inside = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_measurements(spark, edge_docs, clashing_docs, no_docs, rows_of):
    extra = ["a b c a b c a b c", "a a a a", "l\nl\nl\n\n\nl ", "# * $ % & | < > x", "a\x0bb\x0cc\rd\te", prose(9, 400) + " " + prose(9, 30), "T | T\n" * 40, "X! " * 60]
    df = edge_docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(extra, 100)), "doc_id long, text string"))
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted(((r.doc_id, *[r[c] for c in cols], r.base_failed) for r in quality_rules(df).collect()), key=repr)
    want = sorted(((r.doc_id, *(b := brute(r.text)), b[0] < 50 or 100 * b[4] > 50 * b[0]) for r in df.collect()), key=repr)
    assert got == want
    assert rows_of(quality_rules(clashing_docs)) == rows_of(quality_rules(edge_docs))
    assert rows_of(quality_rules(no_docs)) == []


def test_bits_and_policies(spark):
    texts = {1: prose(1, 100), 2: "few", 3: "same same same " * 40, 4: prose(2, 100).replace(" ", "&&& "), 5: "\n".join(["one line"] * 3 + ["two"] * 30),
             6: prose(4, 100).upper(), 7: " ".join("abcdefghijklmnopqrstuvwxyzabc" + str(k) for k in range(60))}
    entries = ledger(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).cache()
    failed = {r.doc_id: {RULES[i] for i in range(len(RULES)) if r.failed_bits >> i & 1} for r in entries.collect()}
    assert failed[1] == set() and failed[2] == {"few_words"} and failed[4] == {"symbols"} and failed[6] == {"capitals"} and failed[7] == {"word_length"}
    assert "repeat_words" in failed[3] and "dup_lines" in failed[5]
    for version, mask in POLICIES.items():
        kept = {r.doc_id for r in apply_policy(entries, version).where("kept").collect()}
        assert kept == {i for i, f in failed.items() if not any(mask >> RULES.index(x) & 1 for x in f)}
    got = {(r.version, r.rule): (r.n_rejected, r.n_failed, r.n_only) for r in ablation(entries).collect()}
    for version, mask in POLICIES.items():
        on = {i: {x for x in f if mask >> RULES.index(x) & 1} for i, f in failed.items()}
        for k, rule in enumerate(RULES):
            if mask >> k & 1:
                assert got[version, rule] == (sum(map(bool, on.values())), sum(rule in f for f in on.values()), sum(f == {rule} for f in on.values()))
    assert BASE_MASK == POLICIES["v1"] and ablation(entries.limit(0)).count() >= 0


def test_no_python_and_no_shuffle(edge_docs):
    plan = quality_rules(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
