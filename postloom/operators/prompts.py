"""Prompt assembly (G2-G7, G5): numbered example blocks, message layouts per
model family, and the ``System: ... User: ...`` prompt parser.

Examples are grouped per request with ``collect_list``; a request holds at
most ``config.MAX_EXAMPLES`` rows, so each group is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import config
from postloom.functions import text as T

# Our own wording for the instruction blocks (structure: numbered examples).
EXAMPLES_HEADER_PAIR = "Real posts from this platform, for style only:\n"
EXAMPLES_HEADER_SINGLE = "\n\n# What people post here\n"
TEMPLATE_HEADER = "\n\n# What people post here\n\n"
INSTRUCTION = ("\n---\n\nWrite one new post that could sit among these. Match their register, length and "
               "punctuation habits without copying any of them. Reply with the post text only.")
MESSAGE_INSTRUCTION = ("Write one new post that could sit among these. Match their register, length and "
                       "punctuation habits without copying any of them. Reply with the post text only.")
TEMPLATE_FOOTER = "---\n\nNow write one new post in this style. Reply with the post text only."


def ordered_examples(examples: DataFrame, group: str = "request_id", order: str = "h", text: str = "text") -> DataFrame:
    """One row per request: ``examples`` = texts sorted by ``order``."""
    return examples.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))),
                    lambda x: x["t"]).alias("examples"))


def numbered_block(examples: Column, template: str = "\nExample {i}:\n{x}\n") -> Column:
    """``Example 1: ...`` block from an array of texts."""
    pre, rest = template.split("{i}")
    mid, post = rest.split("{x}")
    return F.array_join(F.transform(examples, lambda x, i: F.concat(
        F.lit(pre), (i + 1).cast("string"), F.lit(mid), x, F.lit(post))), "")


def single_prompt(system: Column, examples: Column) -> Column:
    """System prompt, numbered examples and the instruction in one string."""
    return F.concat(system, F.lit(EXAMPLES_HEADER_SINGLE), numbered_block(examples), F.lit(INSTRUCTION))


def message_pair(system: Column, examples: Column) -> Column:
    """(system, user) with the examples in the user message."""
    user = F.concat(F.lit(EXAMPLES_HEADER_PAIR), numbered_block(examples), F.lit(INSTRUCTION))
    return F.struct(system.alias("system"), user.alias("user"))


def chat_messages(examples: Column) -> Column:
    """Every example a user turn, then the instruction turn."""
    turns = F.transform(examples, lambda x: F.struct(F.lit("user").alias("role"), x.alias("content")))
    last = F.array(F.struct(F.lit("user").alias("role"), F.lit(MESSAGE_INSTRUCTION).alias("content")))
    return F.concat(turns, last)


def layout(model: Column, system: Column, examples: Column) -> Column:
    """One struct type for every model family:
    claude -> system + messages; azure models -> system + user; others -> prompt."""
    fam_claude = model == "claude"
    fam_azure = model.isin(*config.AZURE_MODELS)
    pair = message_pair(system, examples)
    empty = F.array().cast("array<struct<role:string,content:string>>")
    return F.struct(
        F.when(fam_claude | fam_azure, system).alias("system"),
        F.when(fam_azure, pair["user"]).alias("user"),
        F.when(fam_claude, chat_messages(examples)).otherwise(empty).alias("messages"),
        F.when(~(fam_claude | fam_azure), single_prompt(system, examples)).alias("prompt"),
    )


def parse_prompt(prompt: Column) -> Column:
    """``System: a User: b`` -> [system a, user b] (split at the first
    ``User:``, every ``System:`` removed from the head, both stripped);
    otherwise one user message holding the whole text."""
    p = F.coalesce(prompt, F.lit(""))
    has_both = p.contains("System:") & p.contains("User:")
    at = F.instr(p, "User:")
    head = F.substring(p, F.lit(1), at - 1)
    tail = F.substring(p, at + 5, F.length(p))
    system = T.unicode_strip(F.replace(head, F.lit("System:"), F.lit("")))
    user = T.unicode_strip(tail)
    msg = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return F.when(has_both, F.array(msg("system", system), msg("user", user))).otherwise(F.array(msg("user", p)))


def platform_template(system: Column, examples: Column) -> Column:
    """User-prompt template with up to 12 numbered examples."""
    first = F.slice(examples, 1, config.SAMPLES_PER_PROMPT)
    return F.concat(F.lit(TEMPLATE_HEADER), numbered_block(first, "Example {i}:\n{x}\n\n"), F.lit(TEMPLATE_FOOTER))
