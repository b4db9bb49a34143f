"""Registry of named queries: a Spark builder plus (optionally) its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    fn: QueryFn
    sql: str | None
    ops: str


REGISTRY: dict[str, Entry] = {}


def query(name: str, ops: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``sql`` is the DuckDB oracle over the driver's views; ``None`` marks an
    operator without a SQL equivalent (rows-only check)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, ops)
        return fn

    return deco


# Tables whose rows carry long texts (CPU-heavy regex work per row).
TEXT_TABLES = ("documents", "pages", "conversations")
REBALANCE_CONF = "postloom.scan.rebalancePartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan a driver table.  When ``postloom.scan.rebalancePartitions`` = N > 0,
    text tables are spread round-robin over N partitions: for inputs written as
    a single parquet row group (which one task must read whole) this puts all
    cores to work.  Leave it unset for normally written data, where the scan
    already splits by row group and the extra shuffle would only cost I/O."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    n = int(spark.conf.get(REBALANCE_CONF, "0") or 0)
    if n > 0 and name in TEXT_TABLES:
        df = df.repartition(n)
    return df


def spread(df: DataFrame) -> DataFrame:
    """For heavy work on whole texts: the scan is dealt out to all cores.  The number of its partitions
    does not tell whether that is needed: a file is cut by bytes, but one task reads a whole row group,
    so of many partitions a few may hold all rows."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))
