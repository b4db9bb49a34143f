"""Prompt-template source (S6) and export.

A template file is JSON ``{"metadata": {...}, "templates": {platform: {...}}}``
that may start with a UTF-8 byte-order mark.  It is configuration-sized.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_TEMPLATES = os.path.join(os.path.dirname(__file__), "data", "prompt_templates.json")

TEMPLATE_SCHEMA = "platform string, system_prompt string, num_examples int, user_prompt_template string"


def load_document(path: str = DEFAULT_TEMPLATES) -> dict:
    with open(path, encoding="utf-8-sig") as f:
        return json.load(f)


def load_template_rows(path: str = DEFAULT_TEMPLATES) -> list[tuple]:
    """Driver-side read of a small template file (BOM tolerated)."""
    doc = load_document(path)
    rows = []
    for platform, t in doc.get("templates", {}).items():
        rows.append((t.get("platform", platform), t.get("system_prompt"), int(t.get("num_examples", 0) or 0),
                     t.get("user_prompt_template")))
    return rows


def templates(spark: SparkSession, path: str = DEFAULT_TEMPLATES) -> DataFrame:
    """Templates as a DataFrame (platform, system_prompt, num_examples, user_prompt_template)."""
    return spark.createDataFrame(load_template_rows(path), TEMPLATE_SCHEMA)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Spark read of a template file on shared storage: whole file as text,
    BOM stripped, parsed with ``from_json`` into a platform map, exploded."""
    raw = spark.read.text(path, wholetext=True)
    body = F.regexp_replace(F.col("value"), "^\ufeff", "")
    schema = ("struct<metadata: struct<generated_at: string, samples_per_prompt: int, platforms: array<string>>, "
              "templates: map<string, struct<platform: string, system_prompt: string, num_examples: int, "
              "user_prompt_template: string>>>")
    doc = raw.select(F.from_json(body, schema).alias("doc"))
    return doc.select(F.explode("doc.templates").alias("k", "t")).select(
        F.coalesce(F.col("t.platform"), F.col("k")).alias("platform"), "t.system_prompt", "t.num_examples",
        "t.user_prompt_template")


def export_templates(templates_df: DataFrame, samples_per_prompt: int, generated_at: str) -> DataFrame:
    """One JSON document (one row, one string column) with metadata and a
    platform -> template map; the map has one entry per platform."""
    t = templates_df.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(
            "platform", F.struct("platform", "system_prompt", "user_prompt_template", "num_examples"))))).alias("templates"),
        F.array_sort(F.collect_list("platform")).alias("platforms"))
    meta = F.struct(F.lit(generated_at).alias("generated_at"), F.lit(samples_per_prompt).alias("samples_per_prompt"),
                    F.col("platforms").alias("platforms"))
    return t.select(F.to_json(F.struct(meta.alias("metadata"), F.col("templates"))).alias("value"))
