"""Query of the near-dedup (no SQL oracle: tested against brute-force similarities)."""

from __future__ import annotations

from postloom.llm.near_dedup import classes
from postloom.llm.registry import query, read


@query("op8_near_dedup")
def op8_near_dedup(spark, sf_dir):
    return classes(read(spark, sf_dir, "documents"))
