import pytest

import corpus_pipeline
from postloom.llm.near_dedup import classes
from postloom.llm.decontaminate import leaks
from postloom.llm.quality_model import score
from postloom.llm.queries import ENTRIES
from postloom.session import materialize
from tests.conftest import SF001
from tests.oracle_harness import digest, duck

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = materialize(stage(spark, docs, SF001), "test-stage")
        assert name == "bpe" or docs.columns == COLUMNS
    ids = {name: sorted(r.doc_id for r in d.select("doc_id").collect()) for name, d in seen.items()}
    labels, benchmark = spark.read.parquet(f"{SF001}/labels.parquet"), spark.read.parquet(f"{SF001}/benchmark.parquet")
    good = [r.doc_id for r in score(seen["quality_classifier"], labels).collect() if r.predicted]
    assert ids["near_dedup"] == sorted(good)
    assert ids["decontamination"] == sorted({r.class_id for r in classes(seen["near_dedup"]).collect()})
    assert ids["secret_scan"] == sorted(set(ids["decontamination"]) - {r.doc_id for r in leaks(seen["decontamination"], benchmark).collect()})
    assert ids["bpe"] == ids["secret_scan"] == sorted(r.doc_id for r in docs.collect())
    whole = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF001).collect())
    assert whole == sorted((r.doc_id, r.ids_sha256) for r in docs.collect())


def test_empty_documents(spark, no_docs, edge_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF001).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, edge_docs, SF001).columns == COLUMNS


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql])
def test_queries_match_their_oracles(spark, name):
    con = duck(SF001)
    got, want = ENTRIES[name].fn(spark, SF001).toPandas(), con.execute(ENTRIES[name].sql).df()
    assert digest(got) == digest(want)


def test_entry_module_has_them_all():
    import __spark_entry__ as E

    names = set(E.queries())
    assert set(ENTRIES) | {"pipeline"} <= names and len({n.split("_")[0] for n in ENTRIES}) == 10
