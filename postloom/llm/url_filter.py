"""URL filters: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

Method: the listed canonical URLs are set in a blocked Bloom filter: a hash picks one block of
eight 64-bit words and one bit in each word, so a test reads one block.  URLs that no rule
decides and whose block lacks a bit are allowed at once; possible hits pass to an exact hash
join with the list, which removes the false positives.

Scale: the filter has at most ``MAX_BLOCKS`` blocks (4 MB), whatever the list's length - a
longer list only raises the share of false positives, never the result - so its broadcast
has a proven bound.  The list is never broadcast by this code; the exact join is an ordinary
equi-join of two exchanges, which adaptive execution may split when one URL holds a large
share of the rows.  Rules are a parameter, a few lines of configuration.

Canonical form: host without a leading ``www.`` or ``m.``, path without ``index.html``, ``.html``
and trailing slashes; scheme, query and fragment dropped.

Edge cases: null URL or one without ``://`` has an empty host and path, no rule, and is allowed.
Rows are kept one to one (null or repeated ids too); equal rules: the later one wins.  Columns
beyond the id and the URL are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.columns import let

WORDS = 8  # of 64 bits in a block
MAX_BLOCKS = 1 << 16
KEYS_PER_BLOCK = 32  # 16 bits a key until the filter has its full size


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str  # this host and its subdomains
    path: str  # the URL's path starts with it

    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(path, r"(/index)?\.html?$", ""), "/+$", "")
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), bare)


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def best_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text())):
        out = F.when(_fits(r, host, path), F.struct(F.lit(r.text()).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _block(key: Column, n_blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), n_blocks).cast("int")


def _bit(key: Column, word: int) -> Column:
    """The bit that the key sets in this word of its block: a 64-bit number with one bit."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(word)), F.lit(64)).cast("int"))


def _n_blocks(listed: DataFrame) -> Column:
    """A scalar subquery: blocks for this many keys, up to MAX_BLOCKS."""
    return listed.select(F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(KEYS_PER_BLOCK)))).cast("long").alias("n")).scalar()


def bloom_filter(listed: DataFrame) -> DataFrame:
    """(block, words): one row per block that has a bit, built with partial aggregation.

    ``listed`` has one column ``url_key``; the number of blocks follows its count up to MAX_BLOCKS."""
    bits = listed.select(_block(F.col("url_key"), _n_blocks(listed)).alias("block"), *[_bit(F.col("url_key"), w).alias(f"w{w}") for w in range(WORDS)])
    return bits.groupBy("block").agg(F.array(*[F.bit_or(f"w{w}") for w in range(WORDS)]).alias("words"))


def maybe_listed(key: Column, words: Column) -> Column:
    out = words.isNotNull() & key.isNotNull()
    for w in range(WORDS):
        out = out & (words[w].bitwiseAND(_bit(key, w)) != 0)
    return out


def url_filter(pages: DataFrame, rules: list[Rule], listed: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, possible_hit for every row.

    ``listed`` has one column ``url_key``: canonical URLs to block, without repeats; give a stored
    table, as it is read twice (filter and exact join)."""
    host, path = host_and_path(F.col("url").cast("string"))
    judged = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url")).select("id", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("best", let(F.struct("host", "path"), lambda u: best_rule(rules, u["host"], u["path"])))
    keyed = judged.withColumn("url_key", F.when(F.col("best").isNull() & (F.col("host") != ""), canonical(F.col("host"), F.col("path"))))
    keyed = keyed.withColumn("block", _block(F.col("url_key"), _n_blocks(listed)))
    blocks = F.broadcast(bloom_filter(listed))  # MAX_BLOCKS rows of 8 longs at most
    tested = keyed.join(blocks, "block", "left").withColumn("hit", F.coalesce(maybe_listed(F.col("url_key"), F.col("words")), F.lit(False)))
    exact = listed.select("url_key", F.lit(True).alias("on_list"))
    passed = tested.where(F.col("hit")).join(exact, "url_key", "left")
    missed = tested.where(~F.col("hit")).withColumn("on_list", F.lit(None).cast("boolean"))
    return passed.select(missed.columns).unionByName(missed).select(
        F.col("id").alias(id_column), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(F.col("on_list"), F.lit("block")), F.lit("allow")).alias("verdict"), F.col("hit").alias("possible_hit"))


def repeated_urls(pages: DataFrame, url_column: str = "url") -> DataFrame:
    """Canonical URLs that two or more rows carry under whatever address, as a list for ``url_filter``."""
    host, path = host_and_path(F.col(url_column).cast("string"))
    keys = pages.select(host.alias("host"), path.alias("path")).where("host <> ''").select(canonical(F.col("host"), F.col("path")).alias("url_key"))
    return keys.groupBy("url_key").agg(F.count("*").alias("n")).where("n > 1").select("url_key")
