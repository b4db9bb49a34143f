"""Query of the quality classifier (no SQL oracle: tested by held-out accuracy)."""

from __future__ import annotations

from postloom.llm.quality_model import score
from postloom.llm.registry import query, read


@query("op9_quality_classifier")
def op9_quality_classifier(spark, sf_dir):
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
