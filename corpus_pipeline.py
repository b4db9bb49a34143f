"""The corpus pipeline: documents in, token ids of the documents worth training on out.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and reread as the next one's docs.  All but the last
return the columns of documents:

1. quality_classifier  documents that the factorisation machine scores below 0.3 go
2. near_dedup          one document of each class of near copies stays
3. decontamination     documents that leak a benchmark item go
4. secret_scan         secrets are replaced by a mark; n_chars follows where a text changes
5. bpe                 doc_id, n_tokens, ids and their digests

An empty table passes through all stages; the docstrings of the operators say what each does
with nulls, empty texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postloom.llm.bpe import bpe_encode
from postloom.llm.decontaminate import remove_leaks
from postloom.llm.near_dedup import deduplicate
from postloom.llm.quality_model import keep_good
from postloom.llm.queries_bpe import VOCABULARY
from postloom.llm.registry import read
from postloom.llm.secret_scan import redact
from postloom.session import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_leaks(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_encode(docs, VOCABULARY).drop("decoded")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe", bpe),
]

# training, signatures and merge rounds have no SQL form: tests compare with brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
