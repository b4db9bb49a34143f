"""Quality rules as a bitmask ledger (DataFrame functions only, no shuffle).

Every rule is evaluated once per document.  The ledger stores the measurements and one
failure bit per rule; a policy is a version name and the mask of the rules it enforces, so
policies are applied and compared later by bitwise operations, without the texts.

Rules (bit: fails when)
  0 few_words      n_words < 50
  1 repeat_words   100 * n_repeat_words > 50 * n_words
  2 symbols        100 * n_symbols > 30 * n_words
  3 dup_lines      100 * n_dup_lines > 50 * n_lines (lines with a word), with 4 lines or more
  4 word_length    word_chars < 2 * n_words or word_chars > 25 * n_words
  5 capitals       100 * n_upper > 60 * n_letters, with 50 letters or more

Three-word windows are compared within one text by a 64-bit hash of the three words.

Edge cases: null or empty text has no words, all measurements 0 and fails rule 0 alone.  Rows
are kept one to one (null or repeated doc_id too); extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.columns import WORD, let, upto, without

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
RULES = ("few_words", "repeat_words", "symbols", "dup_lines", "word_length", "capitals")
BASE_MASK = 0b000011
POLICIES = {"v1": BASE_MASK, "v2": 0b111111}
WINDOW = 3


def _repeated(words: Column) -> Column:
    """Number of words inside three-word windows that the text holds at least twice."""
    hashed = F.transform(upto(F.size(words) - (WINDOW - 1)),
                         lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i")))

    def starts(s: Column) -> Column:  # sorted by hash: a window repeats if a neighbour has its hash
        def mark(k: Column) -> Column:
            same = F.coalesce(F.get(s, k + 1)["h"] == s[k]["h"], F.lit(False)) | F.coalesce(F.get(s, k - 1)["h"] == s[k]["h"], F.lit(False))
            return F.when(same, s[k]["i"])

        return F.sort_array(F.array_compact(F.transform(upto(F.size(s)), mark)))

    def covered(p: Column) -> Column:  # a window adds the words up to the next window's start, three at most
        return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))),
                           F.lit(0).cast("long"), lambda a, x: a + x)

    return let(F.sort_array(hashed), lambda s: let(starts(s), covered))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed_bits`` (bit i: rule i fails)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(without(x, SPACES)) > 0)
    measured = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        F.length(without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("text", r"\P{L}+", "")).cast("long").alias("n_letters"),
    ).select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "n_upper", "n_letters")
    c = F.col
    fails = (
        c("n_words") < 50,
        100 * c("n_repeat_words") > 50 * c("n_words"),
        100 * c("n_symbols") > 30 * c("n_words"),
        (100 * c("n_dup_lines") > 50 * c("n_lines")) & (c("n_lines") >= 4),
        (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 25 * c("n_words")),
        (100 * c("n_upper") > 60 * c("n_letters")) & (c("n_letters") >= 50),
    )
    bits = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, f in enumerate(fails)), F.lit(0).cast("long"))
    return measured.withColumn("failed_bits", bits)


def apply_policy(entries: DataFrame, version: str, policies: dict[str, int] | None = None) -> DataFrame:
    """Adds ``kept``: none of the rules that the policy enforces fails."""
    mask = (policies or POLICIES)[version]
    return entries.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablation(entries: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """Per policy version and rule it enforces: documents the policy rejects, documents the rule
    fails, and documents that only this rule rejects (dropping it would keep them).

    The ledger shrinks to one row per bit pattern (2 ** rules at most) before anything else."""
    patterns = entries.groupBy("failed_bits").agg(F.count("*").alias("n"))
    cells = [F.struct(F.lit(v).alias("version"), F.lit(m).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
             for v, m in (policies or POLICIES).items() for i, r in enumerate(RULES) if m >> i & 1]
    hit = F.col("failed_bits").bitwiseAND(F.col("mask"))
    total = lambda on: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0))
    return patterns.select("failed_bits", "n", F.explode(F.array(*cells)).alias("c")).select("failed_bits", "n", "c.*").groupBy("version", "rule").agg(
        total(hit != 0).alias("n_rejected"), total(hit.bitwiseAND(F.col("bit")) != 0).alias("n_failed"), total(hit == F.col("bit")).alias("n_only"))


def quality_rules(docs: DataFrame, version: str = "v2") -> DataFrame:
    entries = apply_policy(ledger(docs), version)
    return entries.withColumn("base_failed", F.col("failed_bits").bitwiseAND(F.lit(BASE_MASK).cast("long")) != 0)
