"""Per-text stylometric Column functions (burstiness, punctuation density,
lexical diversity).  All JVM-side higher-order functions; no Python worker.

Sentence and word splitting are regex rules, not a trained tokenizer:
a sentence ends after a run of ``.``, ``!`` or ``?`` followed by whitespace;
a token is a run of word characters or one character that is neither word nor
space.  (This differs from a Punkt/Treebank tokenizer on abbreviations,
contractions and ellipses.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.text import PUNCT, SPACE, SPACE_BODY, WORD, WORD_BODY, unicode_strip

TOKEN_RE = f"{WORD}+|{PUNCT}"
ALNUM_RE = r"^[\p{L}\p{N}]+$"
SENTENCE_END_RE = f"([.!?]+){SPACE}+"
SEP = "\u0001"
TOK = "\u0002"
TOKEN_NO_SEP_RE = f"{WORD}+|[^{WORD_BODY}{SPACE_BODY}\\x01]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` as a lambda variable (a
    one-element ``transform``), so a Column tree does not recompute it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def sentences(c) -> Column:
    pieces = F.split(F.regexp_replace(F.coalesce(_c(c), F.lit("")), SENTENCE_END_RE, "$1" + SEP), SEP)
    return F.filter(pieces, lambda s: unicode_strip(s) != "")


def tokens(c) -> Column:
    return F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(TOKEN_RE), 0)


def sentence_token_counts(c) -> Column:
    """Tokens per non-blank sentence, in three whole-text regex passes: mark
    sentence ends, turn every token into one marker character, drop the rest;
    the pieces between end marks then have one character per token.  (Blank
    sentences are exactly the pieces without tokens.)"""
    marked = F.regexp_replace(F.coalesce(_c(c), F.lit("")), SENTENCE_END_RE, "$1" + SEP)
    tok = F.regexp_replace(marked, TOKEN_NO_SEP_RE, TOK)
    only = F.regexp_replace(tok, f"[^{SEP}{TOK}]", "")
    pieces = F.filter(F.split(only, SEP), lambda p: F.length(p) > 0)
    return F.transform(pieces, lambda p: F.length(p).cast("double"))


def variance(counts: Column) -> Column:
    """Population variance of an array of doubles; 0.0 if it is empty."""

    def of(cs: Column) -> Column:
        n = F.size(cs)
        return let(F.aggregate(cs, F.lit(0.0), lambda acc, x: acc + x) / n,
                   lambda mean: F.aggregate(cs, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / n)

    return let(counts, lambda cs: F.when(F.size(cs) == 0, F.lit(0.0)).otherwise(of(cs)))


def burstiness(c) -> Column:
    """Population variance of tokens per sentence; 0.0 without sentences."""
    return variance(sentence_token_counts(c))


def punctuation_density(c) -> Column:
    """Characters that are neither word nor space, over all characters; 0.0 if empty."""
    t = _c(c)
    n = F.length(t)
    k = n - F.length(F.regexp_replace(t, PUNCT, ""))
    return F.when(t.isNull() | (n == 0), F.lit(0.0)).otherwise(k.cast("double") / n.cast("double"))


# a maximal run of word characters without an underscore = an alphanumeric token
ALNUM_TOKEN_RE = r"(?<![\p{L}\p{N}_])[\p{L}\p{N}]+(?![\p{L}\p{N}_])"


def alnum_words(c) -> Column:
    """Lower-cased tokens made only of letters and digits (one regex pass)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(ALNUM_TOKEN_RE), 0)


def lexical_diversity(c) -> Column:
    """Distinct over total lower-cased alphanumeric tokens; 0.0 without any."""
    return let(alnum_words(c), lambda w: F.when(F.size(w) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_distinct(w)).cast("double") / F.size(w).cast("double")))
