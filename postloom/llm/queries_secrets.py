"""Query of the secret scan (no SQL oracle: tested against a brute-force scan)."""

from __future__ import annotations

from postloom.llm.registry import query, read
from postloom.llm.secret_scan import find_secrets


@query("op10_secret_scan")
def op10_secret_scan(spark, sf_dir):
    return find_secrets(read(spark, sf_dir, "documents"))
