"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

COMPRESSION = "zstd"  # of what is written for later steps: texts take about three quarters of the room that snappy needs
RELEASE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "postloom") -> SparkSession:
    """Session used by tests and bench.  On a cluster the caller brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there.  Where it is unset, a local session (tests) gets a
    folder of its own; any other master is refused, as executors would write to their own disks."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="postloom-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


_scratch: list[str] = []  # folders this process has handed out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (for written intermediate tables)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    _scratch.append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders handed out so far; returns how many.  Call it once the results
    that read them are written or collected (a DataFrame built on them can't be read afterwards)."""
    n = len(_scratch)
    while _scratch:
        path = _scratch.pop()
        file_system(spark, path).delete(hadoop_path(spark, path), True)
    return n


def hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path: the store may be one that only Spark reads."""
    return hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return file_system(spark, path).exists(hadoop_path(spark, path))


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a Spark job has finished writing ``path`` (its ``_SUCCESS`` marker)."""
    return exists(spark, f"{path}/_SUCCESS")


def mark_committed(spark: SparkSession, path: str) -> None:
    """Put the marker of a finished job into ``path``."""
    file_system(spark, path).create(hadoop_path(spark, f"{path}/_SUCCESS"), True).close()


def sub_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none if it does not exist.  Any other fault is raised."""
    if not exists(spark, path):
        return []
    return sorted(s.getPath().getName() for s in file_system(spark, path).listStatus(hadoop_path(spark, path)) if s.isDirectory())


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What is run here deletes its shuffle files when it is done: else they stay until the driver's garbage
    collector happens to find them, and a chain of stored tables keeps those of all its steps on the disk."""
    before = spark.conf.get(RELEASE_CONF, None)
    spark.conf.set(RELEASE_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE_CONF) if before is None else spark.conf.set(RELEASE_CONF, before)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stored intermediates that no later step reads (``release_scratch`` deletes the rest)."""
    for path in paths:
        file_system(spark, path).delete(hadoop_path(spark, path), True)


def materialize(df, name: str, path: str | None = None):
    """Write ``df`` as parquet under the shared checkpoint folder and read it
    back: the plan runs once, several consumers read the result, and the
    lineage is cut (a lost executor does not force a recompute upstream).
    With ``path`` (of ``scratch_path``) the caller can ``discard`` it."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    with shuffles_released(spark):
        df.write.mode("overwrite").option("compression", COMPRESSION).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
