"""F1 with learned sentence boundaries: abbreviations are found in the corpus, without a list.

A word that nearly always carries a period, more often than periods are common, is an abbreviation
(collocation of a word and its period, after Kiss and Strunk, "Unsupervised multilingual sentence
boundary detection", 2006).  For a type of length n (periods inside not counted), seen c1 times with and
c0 times without a final period, among N tokens of which P end with one:

    llr   = 2 * (log L(c1; c0 + c1, 0.99) - log L(c1; c0 + c1, P / N)),   L the binomial likelihood
    score = llr * exp(-n) * (inner periods + 1) * n ** -c0

and score >= ``THRESHOLD`` makes a type that holds a letter an abbreviation, as does being one letter
(an initial).  A
sentence then ends after a run of ``.``, ``!`` or ``?`` before white space, but not after an
abbreviation with its one period.

Types are counted inside their rows first, then over the corpus; the table of abbreviations is
met by a join (hot ones by broadcast), so it may be of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import stylometry as ST
from postloom.functions.text import WORD
from postloom.operators import features as FE
from postloom.session import materialize

TYPE_RE = rf"{WORD}+(?:\.{WORD}+)*\.?"
LAST_RE = rf"(?:^|[^\p{{L}}\p{{N}}_.])({WORD}+(?:\.{WORD}+)*)\.$"
THRESHOLD = 0.3
ABBREVIATION_SHARE = 0.99


def type_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(type, with_period, without) over all texts, lower-cased."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TYPE_RE), 0)
    runs = FE._runs(F.sort_array(tokens), lambda x: x, lambda x, run: F.struct(x.alias("t"), F.size(run).cast("long").alias("k")))
    seen = df.select(F.explode(runs).alias("r")).select("r.t", "r.k")
    ends = F.col("t").endswith(".")
    return seen.groupBy(F.regexp_replace("t", r"\.$", "").alias("type")).agg(
        F.sum(F.when(ends, F.col("k")).otherwise(0)).alias("with_period"), F.sum(F.when(ends, 0).otherwise(F.col("k"))).alias("without"))


def abbreviations(counts: DataFrame) -> DataFrame:
    """(word, score, cnt) of the types that are abbreviations; ``counts``: a stored result of ``type_counts``."""
    total, periods = counts.agg(F.coalesce(F.sum(F.col("with_period") + F.col("without")), F.lit(0)), F.coalesce(F.sum("with_period"), F.lit(0))).first()
    if not periods:
        return counts.sparkSession.createDataFrame([], "word string, score double, cnt long")
    n = F.length(F.replace("type", F.lit("."), F.lit(""))).cast("double")
    inner = (F.length("type") - n).cast("double")
    c1, c0 = F.col("with_period").cast("double"), F.col("without").cast("double")

    def log_likelihood(p: float) -> Column:
        # a share of 1 leaves no room for words without a period
        miss = F.lit(0.0) if p >= 1 else F.log(F.lit(1 - p))
        return c1 * F.log(F.lit(p)) + c0 * miss

    llr = 2 * (log_likelihood(ABBREVIATION_SHARE) - log_likelihood(periods / total))
    score = llr * F.exp(-n) * (inner + 1) * F.pow(n, -c0)
    some = counts.where(F.col("with_period") > 0).select(F.col("type").alias("word"), score.alias("score"), (F.col("with_period") + F.col("without")).alias("cnt"))
    initial = (F.length("word") == 1) & F.col("word").rlike(r"^\p{L}$")
    return some.where(((F.col("score") >= THRESHOLD) & F.col("word").rlike(r"\p{L}")) | initial)  # a number is none


def _sentence_parts(text: str) -> Column:
    """Pieces between possible ends: tokens in each, and the type before its one final period."""
    return F.transform(ST.sentences(text), lambda s: F.struct(
        F.size(F.regexp_extract_all(s, F.lit(ST.TOKEN_RE), 0)).cast("long").alias("n"),
        F.nullif(F.regexp_extract(F.lower(s), LAST_RE, 1), F.lit("")).alias("word")))


def sentence_lengths(df: DataFrame, key: str | list[str], text: str = "text", table: DataFrame | None = None, carry: list[str] | None = None) -> DataFrame:
    """The keys (and ``carry``) of every row and ``lengths``: tokens in each of its sentences.  ``table``: a stored table of
    abbreviations, by default that of the texts themselves."""
    if table is None:
        table = materialize(abbreviations(materialize(type_counts(df, text), "type-counts")), "abbreviations")
    columns = [*FE._keys(key), *(carry or [])]
    numbered = F.transform(_sentence_parts(text), lambda p, i: F.struct(i.alias("i"), p["n"].alias("n"), p["word"].alias("word")))
    rows = FE._carried(df, columns, numbered, "p").select(FE.ROW, "__carried", "p.i", "p.n", "p.word")
    found = FE._look_up(rows, table, ["word"], "score", "cnt", [FE.ROW])
    carried, named = FE._one(columns)
    part = F.when(F.col("i").isNotNull(), F.struct("i", "n", F.col("score").isNotNull().alias("goes_on")))
    per = found.groupBy(FE.ROW).agg(F.sort_array(F.collect_list(part)).alias("__parts"), carried)
    start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).cast("bigint").alias("open"))
    joined = F.aggregate("__parts", start, lambda a, p: F.when(p["goes_on"], F.struct(a["done"].alias("done"), (a["open"] + p["n"]).alias("open"))).otherwise(
        F.struct(F.concat(a["done"], F.array(a["open"] + p["n"])).alias("done"), F.lit(0).cast("bigint").alias("open"))),
        lambda a: F.when(a["open"] > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))
    return per.select(*named, joined.alias("lengths"))


def learned_burstiness(df: DataFrame, key: str | list[str], text: str = "text", table: DataFrame | None = None, carry: list[str] | None = None) -> DataFrame:
    """F1: population variance of tokens per sentence, with learned boundaries; 0.0 without sentences."""
    lengths = sentence_lengths(df, key, text, table, carry)
    return lengths.select(*[c for c in lengths.columns if c != "lengths"], ST.variance(F.transform("lengths", lambda x: x.cast("double"))).alias("burstiness"))
