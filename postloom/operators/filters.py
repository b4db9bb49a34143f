"""Row filters: sample-pool quality, example selection, incremental cursors, recency."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import config
from postloom.functions import text as T


def in_pool_sql(col: str = "text", lo: int = config.MIN_TEXT_LENGTH, hi: int = config.MAX_TEXT_LENGTH) -> Column:
    t = F.col(col)
    return t.isNotNull() & (F.trim(t) != "") & F.length(t).between(lo, hi)


def in_pool_strip(col: str = "text", lo: int = config.MIN_TEXT_LENGTH, hi: int = config.MAX_TEXT_LENGTH) -> Column:
    t = F.coalesce(F.col(col), F.lit(""))
    return (T.unicode_strip(t) != "") & F.length(t).between(lo, hi)


def pool_filter_sql(df: DataFrame, col: str = "text", lo: int = config.MIN_TEXT_LENGTH,
                    hi: int = config.MAX_TEXT_LENGTH) -> DataFrame:
    """Not NULL, ``TRIM(text) <> ''`` (spaces only), lo <= length <= hi."""
    return df.filter(in_pool_sql(col, lo, hi))


def pool_filter_strip(df: DataFrame, col: str = "text", lo: int = config.MIN_TEXT_LENGTH,
                      hi: int = config.MAX_TEXT_LENGTH) -> DataFrame:
    """NULL -> '', non-empty after a Unicode strip, length bounds on the text."""
    return df.filter(in_pool_strip(col, lo, hi))


def no_media(col: str = "has_media") -> Column:
    """``has_media = 0 OR has_media IS NULL``."""
    return ~F.coalesce(F.col(col), F.lit(False))


def example_filter(df: DataFrame, platform: str, lo: int, hi: int, col: str = "text") -> DataFrame:
    """One platform, a length range, posts without media (SQL trim flavour)."""
    return pool_filter_sql(df, col, lo, hi).filter((F.col("platform") == platform) & no_media())


def after_cursor(posts: DataFrame, state: DataFrame, keys: list[str], ts: str = "created_at",
                 state_ts: str = "last_timestamp", keep_null_ts: bool = False, flag: str | None = None) -> DataFrame:
    """P4/P5 with J8: keep rows newer than the cursor of their key, or all rows of a
    key without cursor.  ``keys`` are matched null-safe (a NULL query is a key).
    With ``flag`` every row stays and a column of that name tells whether it is kept."""
    s = state.select(*[F.col(k).alias(f"__s_{k}") for k in keys], F.col(state_ts).alias("__cursor"))
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__s_{k}"))
        cond = c if cond is None else cond & c
    j = posts.join(s, cond, "left")
    keep = F.col("__cursor").isNull() | (F.col(ts) > F.col("__cursor"))
    if keep_null_ts:
        keep = keep | F.col(ts).isNull()
    j = j.filter(keep) if flag is None else j.withColumn(flag, F.coalesce(keep, F.lit(False)))
    return j.withColumn("had_cursor", F.col("__cursor").isNotNull()).drop(
        *[f"__s_{k}" for k in keys], "__cursor")


def after_id(posts: DataFrame, state: DataFrame, keys: list[str], id_col: str = "post_id",
             state_id: str = "last_post_id", flag: str | None = None) -> DataFrame:
    """Ids after the cursor.  Numeric ids compare as numbers of up to 38 digits (string ids
    compare wrongly); ids that are no such number sort after all numeric ones, among themselves by
    (length, text), so a mixed feed still has one order and no row fails the job.  ``flag`` as in ``after_cursor``."""
    s = state.select(*[F.col(k).alias(f"__s_{k}") for k in keys], F.col(state_id).alias("__since"))
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__s_{k}"))
        cond = c if cond is None else cond & c

    def place(c: Column) -> Column:
        text = c.cast("string")
        number = F.when(text.rlike(r"^\s*[+-]?[0-9]{1,38}\s*$"), text.try_cast("decimal(38,0)"))
        word = F.when(number.isNull(), text)
        return F.struct(number.isNull().alias("word"), number.alias("n"), F.length(word).alias("size"), word.alias("t"))

    j, keep = posts.join(s, cond, "left"), F.col("__since").isNull() | (place(F.col(id_col)) > place(F.col("__since")))
    j = j.filter(keep) if flag is None else j.withColumn(flag, F.coalesce(keep, F.lit(False)))
    return j.drop(*[f"__s_{k}" for k in keys], "__since")


def within_hours(df: DataFrame, ts: str, as_of: Column | dt.datetime, hours: int = 24) -> DataFrame:
    """``ts > as_of - hours``; ``as_of`` is a parameter (a literal or a scalar subquery)."""
    a = F.lit(as_of) if isinstance(as_of, dt.datetime) else as_of
    return df.filter(F.col(ts) > a - F.make_dt_interval(hours=F.lit(hours)))
