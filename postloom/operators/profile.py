"""Profiling aggregates (audit): counts, shares, NULL profile, length statistics.

Every aggregate is a hash aggregate with map-side partial aggregation, so a hot
platform costs one partial row per task before the shuffle.  The exact median
(``percentile``) keeps one counter per distinct value in a group; text lengths
inside the pool are bounded (10..1000), so its state is bounded too.  Pass
``approx=True`` for ``percentile_approx`` on unbounded columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import text as T


def counts_with_share(df: DataFrame, key: str = "platform") -> DataFrame:
    """Rows per key with the percentage of the total (A1/A2).  The total is a
    scalar subquery (one global count), so no window or join spans the groups."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = df.select(F.count(F.lit(1))).scalar()
    return g.withColumn("pct", F.col("n") * 100.0 / total)


def total_count(df: DataFrame, platform: str | None = None, key: str = "platform") -> DataFrame:
    """A3 with optional P8 filter."""
    if platform is not None:
        df = df.filter(F.col(key) == platform)
    return df.agg(F.count(F.lit(1)).alias("n"))


def date_range(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))


def null_profile(df: DataFrame, only_nonzero: bool = True) -> DataFrame:
    """NULL count and percentage per column in one pass, unpivoted (A5)."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__n")] + [
        F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("long").alias(c) for c in cols
    ]
    wide = df.agg(*aggs)
    long = wide.unpivot("__n", cols, "column_name", "null_count")
    out = long.select("column_name", "null_count",
                      (F.col("null_count") * 100.0 / F.col("__n")).alias("null_pct"))
    return out.filter(F.col("null_count") > 0) if only_nonzero else out


def empty_text(df: DataFrame, col: str = "text") -> DataFrame:
    """Texts that are empty after NULL -> '' and a Unicode strip."""
    e = T.unicode_strip(F.coalesce(F.col(col), F.lit(""))) == ""
    return df.agg(
        F.sum(F.when(e, 1).otherwise(0)).cast("long").alias("empty_count"),
        F.count(F.lit(1)).alias("n"),
    ).select("empty_count", (F.col("empty_count") * 100.0 / F.col("n")).alias("empty_pct"))


def _median(c: Column, approx: bool) -> Column:
    return F.percentile_approx(c, 0.5, 10000).cast("double") if approx else F.median(c).cast("double")


def length_stats(df: DataFrame, key: str = "platform", col: str = "text", approx: bool = False) -> DataFrame:
    """count, mean, median, min, max of the code-point length per key."""
    n = F.length(F.coalesce(F.col(col), F.lit(""))).cast("long")
    return df.select(key, n.alias("__len")).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("__len").alias("mean_len"),
        _median(F.col("__len"), approx).alias("median_len"),
        F.min("__len").alias("min_len"),
        F.max("__len").alias("max_len"),
    )


def pool_profile(pool: DataFrame, min_len: int, max_len: int, key: str = "platform",
                 col: str = "text", approx: bool = False) -> DataFrame:
    """Valid-pool metadata as one row (A8): total, map key -> count, length stats,
    filter settings.  The per-key map, one entry per platform of the table, comes in
    as a scalar subquery."""
    n = F.length(F.col(col)).cast("long")
    stats = pool.select(n.alias("__len")).agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.avg("__len").alias("mean"),
        _median(F.col("__len"), approx).alias("median"),
        F.min("__len").alias("min"),
        F.max("__len").alias("max"),
    )
    per_key = pool.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("n"))))).alias("platforms")
    ).scalar()
    return stats.select(
        "total_samples", per_key.alias("platforms"),
        F.lit(min_len).alias("min_length"), F.lit(max_len).alias("max_length"),
        F.struct("mean", "median", "min", "max").alias("length_stats"),
        F.struct(F.lit(min_len).alias("min_text_length"), F.lit(max_len).alias("max_text_length"),
                 F.lit(True).alias("non_empty")).alias("quality_filters"),
    )


def platform_status(df: DataFrame, ts: str = "created_at", key: str = "platform", shown: int = 5) -> DataFrame:
    """Per platform: total posts, how many recent ones a status view shows, newest."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("total_posts"), F.max(ts).alias("newest")).withColumn(
        "recent_shown", F.least(F.lit(shown).cast("long"), F.col("total_posts")))
