"""Text Column functions (JVM-side regexes; no Python UDF).

The source pipeline uses Python's ``re`` on ``str``, whose ``\\w`` and ``\\s`` are
Unicode classes.  Java's bare ``\\w``/``\\s`` are ASCII, so every pattern here is
written with explicit classes that reproduce Python's:

* word  = letters, numbers, underscore
* space = tab..CR, U+001C..U+0020, U+0085 and the Unicode separators

The same pattern strings run unchanged in DuckDB (RE2), which the oracles use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom import config

# Bodies of the two character classes (without brackets), Java and RE2 syntax.
WORD_BODY = r"\p{L}\p{N}_"
SPACE_BODY = r"\t-\r\x1c-\x20\x{85}\p{Z}"

WORD = f"[{WORD_BODY}]"
SPACE = f"[{SPACE_BODY}]"
NON_SPACE = f"[^{SPACE_BODY}]"
PUNCT = f"[^{WORD_BODY}{SPACE_BODY}]"

HASHTAG_RE = f"#({WORD}+)"
MENTION_RE = f"@({WORD}+)"
URL_RE = f"(https?://{NON_SPACE}+)"
CLEAN_URL_RE = f"(?:http|www){NON_SPACE}+"
CLEAN_MENTION_RE = f"@{WORD}+"
# The same sets for Java alone: what is most frequent stands first, where one comparison decides.
FAST_WORD_RE = f"[a-z{WORD_BODY}]+"
FAST_PUNCT = f"[^a-z {WORD_BODY}{SPACE_BODY}]"
SPACE_RUN_RE = rf" {SPACE}+|[\t-\r\x1c-\x1f\x{{85}}[\p{{Z}}&&[^ ]]]{SPACE}*"  # every run of spaces but a single plain one
STRIP_RE = f"^{SPACE}+|{SPACE}+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unicode_strip(c) -> Column:
    """Python ``str.strip()``: removes Unicode whitespace at both ends."""
    return F.regexp_replace(_col(c), STRIP_RE, "")


def sql_trim(c) -> Column:
    """SQL ``TRIM``: spaces only."""
    return F.trim(_col(c))


def expand_contractions(c) -> Column:
    out = _col(c)
    for short, long in config.CONTRACTIONS:
        out = F.replace(out, F.lit(short), F.lit(long))
    return out


def _where(c: Column, marks: tuple[str, ...], change) -> Column:
    """``change`` where the text holds one of the marks without which it changes nothing; the text is worked out once."""
    def step(x: Column) -> Column:
        holds = x.contains(marks[0])
        for m in marks[1:]:
            holds = holds | x.contains(m)
        return F.when(holds, change(x)).otherwise(x)

    return F.transform(F.array(c), step)[0]


def clean_text(c) -> Column:
    """Lower-case, expand contractions, drop URLs and mentions, drop every
    character that is neither word nor space, collapse whitespace, strip.
    NULL (or any non-string) becomes the empty string."""
    t = F.lower(_col(c))
    t = _where(t, ("'",), expand_contractions)  # each contraction has one
    t = _where(t, ("http", "www"), lambda x: F.regexp_replace(x, CLEAN_URL_RE, ""))
    t = _where(t, ("@",), lambda x: F.regexp_replace(x, CLEAN_MENTION_RE, ""))
    t = F.regexp_replace(t, FAST_PUNCT, "")
    t = F.trim(F.regexp_replace(t, SPACE_RUN_RE, " "))
    return F.coalesce(t, F.lit(""))


def hashtags(c) -> Column:
    """Distinct tags after ``#`` (case kept), sorted for determinism."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(HASHTAG_RE), 1)))


def hashtag_keys(c) -> Column:
    """Lower-cased, then distinct: the unique child key of the tag table."""
    return F.array_sort(F.array_distinct(F.transform(hashtags(c), lambda x: F.lower(x))))


def mentions(c) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(MENTION_RE), 1)))


def urls(c) -> Column:
    """All ``http(s)://`` links in order, duplicates kept."""
    return F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(URL_RE), 1)


def engagement_rate(likes, replies, followers) -> Column:
    """(likes + replies) / followers * 100; 0.0 when followers = 0; NULL when NULL."""
    f = _col(followers)
    return (
        F.when(f.isNull(), F.lit(None).cast("double"))
        .when(f == 0, F.lit(0.0))
        .otherwise((_col(likes) + _col(replies)).cast("double") / f.cast("double") * 100.0)
    )


def format_ts(c) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` or ``N/A``."""
    return F.coalesce(F.date_format(_col(c), "yyyy-MM-dd HH:mm:ss"), F.lit("N/A"))


def format_duration(seconds) -> Column:
    """Whole seconds (fraction dropped) as ``H:MM:SS``, from a day on as ``1 day, H:MM:SS`` or
    ``N days, H:MM:SS``; a negative duration counts days down (``-1 day, 23:59:59``)."""
    s = F.floor(_col(seconds)).cast("long")
    days, rest = F.floor(s / 86400).cast("long"), F.pmod(s, F.lit(86400))
    clock = F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor((rest % 3600) / 60), rest % 60)
    word = F.when(F.abs(days) == 1, F.lit(" day, ")).otherwise(F.lit(" days, "))
    return F.when(days == 0, clock).otherwise(F.concat(days.cast("string"), word, clock))


def last_path_segment(c) -> Column:
    return F.element_at(F.split(_col(c), "/"), -1)


def text_length(c) -> Column:
    """Length in code points, as bigint."""
    return F.length(_col(c)).cast("long")


def token_estimate(c) -> Column:
    """Rough token count: characters div 4."""
    return F.floor(F.length(_col(c)) / 4).cast("long")


def json_array_summary(c) -> Column:
    """``[Array of n items]`` for a JSON array or object (keys), ``None`` for NULL
    or empty, ``[Invalid JSON]`` otherwise."""
    x = _col(c)
    n_arr = F.json_array_length(x)
    n_obj = F.size(F.json_object_keys(x))
    return (
        F.when(x.isNull() | (x == ""), F.lit("None"))
        .when(n_arr.isNotNull(), F.concat(F.lit("[Array of "), n_arr.cast("string"), F.lit(" items]")))
        .when(F.json_object_keys(x).isNotNull(), F.concat(F.lit("[Array of "), n_obj.cast("string"), F.lit(" items]")))
        .otherwise(F.lit("[Invalid JSON]"))
    )


def array_summary(c) -> Column:
    """Native-array form of the summary: ``[Array of n items]`` or ``None``."""
    x = _col(c)
    return F.when(x.isNull(), F.lit("None")).otherwise(F.concat(F.lit("[Array of "), F.size(x).cast("string"), F.lit(" items]")))


def search_route(c) -> Column:
    """``search`` when the query has a space, ``:``, a double quote, ``OR`` or ``AND``
    (case-sensitive substrings); otherwise ``subreddit``."""
    return F.when(_col(c).rlike(r' |:|"|OR|AND'), F.lit("search")).otherwise(F.lit("subreddit"))
