"""Query of the language ID (no SQL oracle: tested by held-out accuracy and a plain Viterbi)."""

from __future__ import annotations

from postloom.llm.language_id import identify
from postloom.llm.registry import query, read


@query("op12_language_id")
def op12_language_id(spark, sf_dir):
    return identify(read(spark, sf_dir, "documents"))
