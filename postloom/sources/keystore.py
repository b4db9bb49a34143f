"""Keys of stored posts in hash buckets (J3, X3): "is it stored already" without shuffling the store.

A key store is a bucketed external table with one partition per segment.  A batch adds its keys as
one segment; an existence check reads the live segments bucket by bucket, so only the incoming keys
are shuffled (to the store's buckets), never the stored ones.  Segments are merged by size classes:
``FAN`` segments of a class become one of the next, so the number of live segments grows with the
logarithm of the number of batches and each key is rewritten that often.

The caller keeps the list of live segments (``[[name, class], ...]``) in its manifest; a segment
that is on no list is not read.  Adding a segment of the same name replaces it, so a retried batch
replaces its keys."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.session import exists, file_system, hadoop_path

BUCKETS = 64
FAN = 8
Segments = list[list]  # [name, class]


@dataclass(frozen=True)
class KeyStore:
    path: str
    key: str = "post_id"
    buckets: int = BUCKETS

    def _table(self, spark: SparkSession) -> str:
        """Name of the external table over ``path`` (a catalog entry only: it holds no data of its own)."""
        name = f"postloom_keys_{hashlib.md5(self.path.encode()).hexdigest()[:16]}_{self.buckets}"
        place = self.path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({self.key} STRING, seg STRING) USING parquet PARTITIONED BY (seg) "
                  f"CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        return name

    def add(self, keys: DataFrame, segment: str) -> None:
        """Write the keys as a segment (replacing one of that name)."""
        spark, view = keys.sparkSession, f"postloom_{uuid.uuid4().hex}"
        name = self._table(spark)
        keys.select(F.col(self.key).cast("string").alias(self.key)).repartition(self.buckets, self.key).createOrReplaceTempView(view)
        try:
            spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (seg = '{segment}') SELECT {self.key} FROM {view}")
        finally:
            spark.catalog.dropTempView(view)

    def keys(self, spark: SparkSession, live: Segments) -> DataFrame:
        """The keys of the live segments."""
        name = self._table(spark)
        parts = " ".join(f"PARTITION (seg = '{s}')" for s, _ in live)
        if parts:
            spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {parts}")
        return spark.table(name).where(F.col("seg").isin(*[s for s, _ in live]) if live else F.lit(False)).select(self.key)

    def stored(self, incoming: DataFrame, live: Segments) -> DataFrame:
        """The rows of ``incoming`` whose key is in a live segment."""
        return incoming.join(self.keys(incoming.sparkSession, live), self.key, "left_semi")

    def compact(self, spark: SparkSession, live: Segments) -> tuple[Segments, list[str]]:
        """Merge full size classes: the new list, and the names of the segments it replaces."""
        live, gone = [list(s) for s in live], []
        level = 0
        while any(c >= level for _, c in live):
            full = [s for s in live if s[1] == level]
            if len(full) >= FAN:
                name = f"m{uuid.uuid4().hex}"
                # read as plain files: a table that is written to cannot be read in the same job
                paths = [p for p in (f"{self.path}/seg={n}" for n, _ in full) if exists(spark, p)]
                schema = f"{self.key} string"
                self.add(spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema), name)
                live = [s for s in live if s not in full] + [[name, level + 1]]
                gone += [s for s, _ in full]
            level += 1
        return live, gone

    def drop(self, spark: SparkSession, segments: list[str]) -> None:
        """Delete segments that no published list names any more."""
        name = self._table(spark)
        for s in segments:
            spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (seg = '{s}')")
            path = f"{self.path}/seg={s}"
            file_system(spark, path).delete(hadoop_path(spark, path), True)
