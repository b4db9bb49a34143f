"""SQL (DuckDB) fragments for the oracles, built from the same pattern constants."""

from __future__ import annotations

from postloom import config
from postloom.functions import stylometry as ST
from postloom.functions import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, {q(T.STRIP_RE)}, '', 'g')"


def clean(e: str) -> str:
    t = f"lower({e})"
    for short, long in config.CONTRACTIONS:
        t = f"replace({t}, {q(short)}, {q(long)})"
    t = f"regexp_replace({t}, {q(T.CLEAN_URL_RE)}, '', 'g')"
    t = f"regexp_replace({t}, {q(T.CLEAN_MENTION_RE)}, '', 'g')"
    t = f"regexp_replace({t}, {q(T.PUNCT)}, '', 'g')"
    t = f"trim(regexp_replace({t}, {q(T.SPACE + '+')}, ' ', 'g'))"
    return f"coalesce({t}, '')"


def tags(e: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(coalesce({e}, ''), {q(T.HASHTAG_RE)}, 1)))"


def tag_keys(e: str) -> str:
    return f"list_sort(list_distinct(list_transform({tags(e)}, lambda x: lower(x))))"


def mentions(e: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(coalesce({e}, ''), {q(T.MENTION_RE)}, 1)))"


def urls(e: str) -> str:
    return f"regexp_extract_all(coalesce({e}, ''), {q(T.URL_RE)}, 1)"


def u32(seed: str, *keys: str) -> str:
    parts = " || '|' || ".join([q(str(seed))] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"CAST(('0x' || substr(md5({parts}), 1, 8)) AS BIGINT)"


def hash_prefix(seed: str, width: int, *keys: str) -> str:
    parts = " || '|' || ".join([q(str(seed))] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"CAST(('0x' || substr(md5({parts}), 1, {width})) AS BIGINT)"


def unit(seed: str, *keys: str) -> str:
    return f"({u32(seed, *keys)} / 4294967296.0)"


def tokens(e: str) -> str:
    return f"regexp_extract_all(coalesce({e}, ''), {q(ST.TOKEN_RE)}, 0)"


def sentences(e: str) -> str:
    pieces = f"string_split(regexp_replace(coalesce({e}, ''), {q(ST.SENTENCE_END_RE)}, '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter({pieces}, lambda s: {strip('s')} <> '')"


def burstiness(e: str) -> str:
    counts = f"list_transform({sentences(e)}, lambda s: CAST(len({tokens('s')}) AS DOUBLE))"
    return (f"(SELECT CASE WHEN len(c) = 0 THEN 0.0 ELSE "
            f"list_sum(list_transform(c, lambda x: (x - list_sum(c) / len(c)) * (x - list_sum(c) / len(c)))) / len(c) END "
            f"FROM (SELECT {counts} AS c))")


def punct_density(e: str) -> str:
    n = f"length({e})"
    k = f"({n} - length(regexp_replace({e}, {q(T.PUNCT)}, '', 'g')))"
    return f"CASE WHEN {e} IS NULL OR {n} = 0 THEN 0.0 ELSE CAST({k} AS DOUBLE) / {n} END"


def alnum_words(e: str) -> str:
    return f"list_filter({tokens(f'lower({e})')}, lambda w: regexp_full_match(w, {q(ST.ALNUM_RE[1:-1])}))"


def lexical_diversity(e: str) -> str:
    w = alnum_words(e)
    return f"CASE WHEN len({w}) = 0 THEN 0.0 ELSE CAST(len(list_distinct({w})) AS DOUBLE) / len({w}) END"
