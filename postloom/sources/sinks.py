"""Sinks: append (S7), insert-or-replace by key into a new table version (S8),
JSON / CSV exports (S9, S10) and the table preview (S12).

Parquet has no row-level update, so a keyed merge writes a complete new
version folder ``<base>/v=<n>``.  A version counts once its ``_SUCCESS`` marker
is there; readers take the highest such one.  No committed version is ever
overwritten: a failed writer leaves a folder without marker, which the next
merge replaces.  Only "no such folder" means "no table"; any other fault of the
store is raised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import text as T
from postloom.operators.tables import last_wins, latest_wins
from postloom.session import committed, sub_folders


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("platform",)) -> None:
    """Append rows (e.g. ``synthetic_posts``), partitioned by platform."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def synthetic_layout(results: DataFrame) -> DataFrame:
    """S7 columns: ``text_length`` (code points) and ``is_synthetic = 1``."""
    return results.withColumn("text_length", T.text_length("text")).withColumn("is_synthetic", F.lit(1))


def latest_version(spark: SparkSession, base: str) -> int | None:
    """Highest committed version number under ``base`` (folder names and markers only)."""
    names = [n for n in sub_folders(spark, base) if n.startswith("v=")]
    return max((int(n[2:]) for n in names if committed(spark, f"{base}/{n}")), default=None)


def read_latest(spark: SparkSession, base: str) -> DataFrame | None:
    v = latest_version(spark, base)
    if v is None:
        return None
    return spark.read.parquet(f"{base}/v={v}")


def merge_into_new_version(spark: SparkSession, new: DataFrame, base: str, keys: list[str], order: list[str] | None = None) -> int:
    """Insert-or-replace ``new`` rows by key (of several for a key the last by ``order``);
    returns the version written."""
    v = latest_version(spark, base)
    if v is None:
        merged = last_wins(new, keys, order).drop(*(order or []))
    else:
        merged = latest_wins(spark.read.parquet(f"{base}/v={v}"), new, keys, order)
    nv = 0 if v is None else v + 1
    merged.write.mode("overwrite").parquet(f"{base}/v={nv}")
    return nv


def export_json(df: DataFrame, path: str, single_file: bool = False) -> None:
    """JSON lines (metadata struct, preview rows).  ``single_file`` only for
    small, already aggregated frames."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header (e.g. rows for manual labelling)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def preview(df: DataFrame, order: list[str], n: int = 5, array_cols: tuple[str, ...] = (), count: str | None = None) -> DataFrame:
    """First ``n`` rows in an explicit order, long arrays summarised; with ``count``
    each row also carries the table's number of rows."""
    out = df.orderBy(*order).limit(n)
    if count:
        out = out.withColumn(count, df.select(F.count(F.lit(1))).scalar())
    for c in array_cols:
        out = out.withColumn(c, T.array_summary(c))
    return out
