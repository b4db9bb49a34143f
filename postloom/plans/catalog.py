"""Imports every query module so that the registry is complete."""

from postloom.plans import (  # noqa: F401
    q_features,
    q_ledger,
    q_normalize,
    q_profile,
    q_prompts,
    q_sampling,
    q_sinks,
    q_stream,
    q_tables,
    q_text,
)
