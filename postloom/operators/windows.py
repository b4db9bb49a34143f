"""Window / ranking operators: newest N per query, first N per thread, most
recent N overall, trailing-window request audit (W1, W2, W4, L1-L4)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.operators.sampling import top_k_per_group


def newest_per_key(df: DataFrame, keys: list[str], n: int, ts: str = "created_at", tie: str = "post_id") -> DataFrame:
    """Newest ``n`` rows per key (``WindowGroupLimit`` keeps n per task and key)."""
    return top_k_per_group(df, keys, n, [F.col(ts).desc(), F.col(tie)])


def first_per_key(df: DataFrame, keys: list[str], n: int, order: list[str]) -> DataFrame:
    """First ``n`` rows per key in ``order``."""
    return top_k_per_group(df, keys, n, [F.col(c) for c in order])


def most_recent(df: DataFrame, n: int, ts: str, tie: str) -> DataFrame:
    """L1/L2/L3: newest first, ``n`` rows (``TakeOrderedAndProject``)."""
    return df.orderBy(F.col(ts).desc(), F.col(tie)).limit(n)


def trailing_window_audit(df: DataFrame, key: str, ts: str, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """For every request, how many earlier requests of its key fall inside the
    trailing ``period`` (t - period, t]; whether that reaches the ceiling; and
    the wait ``period - (t - oldest)`` a limiter would impose.  Keys without a
    limit are dropped.

    One window for all keys: time is scaled per key by ``L / period`` (``L`` =
    lcm of the periods), so every frame is the same ``(s - L, s]``.
    Skew-safe: rows are bucketed by ``floor(s / L)``; each row is also copied
    into the next bucket as context, and the window runs per (key, bucket), so
    a partition holds two periods of one key however large the key is."""
    periods = [int(p) for _, p in limits.values()]
    big = 1
    for p in periods:
        big = big * p // math.gcd(big, p)
    big_us = big * 1_000_000
    lim = df.sparkSession.createDataFrame(
        [(k, int(r), int(p), big // int(p)) for k, (r, p) in limits.items()],
        f"{key} string, __max long, __period_s long, __scale long")
    x = df.join(F.broadcast(lim), key)  # limits are config-sized
    t = F.unix_micros(F.col(ts).cast("timestamp")) if dict(df.dtypes)[ts] == "timestamp" else \
        F.unix_micros(F.to_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone()))
    x = x.withColumn("__s", t * F.col("__scale")).withColumn("__b", F.floor(F.col("__s") / big_us).cast("long"))
    both = x.withColumn("__own", F.lit(True)).unionByName(
        x.withColumn("__b", F.col("__b") + 1).withColumn("__own", F.lit(False)))
    w = Window.partitionBy(key, "__b").orderBy("__s").rangeBetween(-(big_us - 1), 0)
    res = both.withColumn("__cnt", F.count(F.lit(1)).over(w)).withColumn(
        "__oldest", F.min("__s").over(w)).filter("__own")
    n_prior = F.col("__cnt") - 1
    over = n_prior >= F.col("__max")
    since_oldest_s = (F.col("__s") - F.col("__oldest")) / F.col("__scale") / 1e6
    wait = F.when(over, F.col("__period_s") - since_oldest_s).otherwise(F.lit(0.0))
    return res.select(*df.columns, n_prior.alias("n_in_window"), over.alias("over_limit"), wait.alias("wait_s"))
