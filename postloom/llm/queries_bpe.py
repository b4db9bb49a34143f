"""Query of the BPE encoder (no SQL oracle: tested against the tokenizers library)."""

from __future__ import annotations

import os

import public_tokenizers

from postloom.llm.bpe import bpe_encode
from postloom.llm.registry import query, read

VOCABULARY = os.environ.get("POSTLOOM_VOCABULARY") or public_tokenizers.path("word_bpe_49k.json")


@query("op7_bpe")
def op7_bpe(spark, sf_dir):
    return bpe_encode(read(spark, sf_dir, "documents"), VOCABULARY, digest=True)
