"""Scrape job plan (N9): one polling job per (platform, query) with the
platform's interval (a platform without one polls every 15 minutes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom import config


def intervals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(config.POLL_INTERVALS.items()), "platform string, minutes int")


def job_plan(spark: SparkSession, queries: DataFrame) -> DataFrame:
    """``queries`` has (platform, query).  Platforms without an implementation
    are skipped; a job id that repeats replaces the earlier one (one row per
    id); the interval table is config-sized, so it is broadcast."""
    q = queries.filter(F.col("platform").isin(*config.PLATFORMS)).dropDuplicates(["platform", "query"])
    j = q.join(F.broadcast(intervals(spark)), "platform", "left")

    def fmt(pattern: str):
        pre, rest = pattern.split("{platform}")
        mid, post = rest.split("{query}")
        return F.concat(F.lit(pre), F.col("platform"), F.lit(mid), F.col("query"), F.lit(post))

    out = j.select("platform", "query",
                   F.coalesce(F.col("minutes"), F.lit(config.DEFAULT_POLL_MINUTES)).alias("interval_minutes"),
                   fmt(config.JOB_ID_FORMAT).alias("job_id"), fmt(config.JOB_NAME_FORMAT).alias("job_name"))
    return out.dropDuplicates(["job_id"])
