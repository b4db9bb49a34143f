"""Imports every query module of this subpackage: one query per operator, each over its
whole table with production parameters."""

from postloom.llm import (  # noqa: F401
    queries_audit,
    queries_bpe,
    queries_chat,
    queries_decontaminate,
    queries_html,
    queries_language,
    queries_near,
    queries_negatives,
    queries_quality,
    queries_rules,
    queries_secrets,
    queries_substring,
    queries_urls,
)
from postloom.llm.registry import ENTRIES  # noqa: F401
