"""Query of the HTML extraction (no SQL oracle: tested against pages with known texts)."""

from __future__ import annotations

from postloom.llm.html_text import extract
from postloom.llm.registry import query, read


@query("op2_html_text")
def op2_html_text(spark, sf_dir):
    return extract(read(spark, sf_dir, "pages"))
