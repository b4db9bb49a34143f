"""Query of the decontamination (no SQL oracle: tested against brute-force tiling)."""

from __future__ import annotations

from postloom.llm.decontaminate import leaks
from postloom.llm.registry import query, read


@query("op3_decontamination")
def op3_decontamination(spark, sf_dir):
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
