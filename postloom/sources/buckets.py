"""A keyed table that is rewritten bucket by bucket (S8, J6): copy-on-write.

Rows lie in hash buckets of their key, each bucket in the folder of the merge that wrote it last:
``<path>/data/gen=<id>/bucket=<b>/``.  A manifest says which folder each bucket is in.  A merge reads
the buckets that its keys fall into, writes these anew and publishes a manifest that points to
them, so what it reads and writes follows the update, not the table; readers see the table before
or after the merge, and a writer that dies before publishing leaves folders that nobody reads.  Two
merges at once: the second to publish fails and may be repeated.  ``vacuum`` deletes folders that no
kept manifest names.

Keys may be null (null equals null).  Columns that a merge adds are null in older rows."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postloom.operators import tables as TB
from postloom.session import exists, file_system, hadoop_path, materialize, sub_folders
from postloom.sources import manifest as MF

BUCKETS = 64
_BUCKET = "__bucket"


@dataclass(frozen=True)
class BucketTable:
    path: str
    keys: tuple[str, ...]
    buckets: int = BUCKETS  # of a new table; an existing one keeps its own

    def _manifest(self, spark: SparkSession) -> tuple[int, dict]:
        version, doc = MF.read(spark, f"{self.path}/live")
        return version, {"buckets": self.buckets, "schema": None, "live": {}} | doc

    def version(self, spark: SparkSession) -> int:
        """The published version; -1 if there is none."""
        return self._manifest(spark)[0]

    def _folder(self, bucket: str, generation: str) -> str:
        return f"{self.path}/data/gen={generation}/{_BUCKET}={bucket}"

    def _rows(self, spark: SparkSession, doc: dict, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(doc["schema"]))
        folders = [self._folder(b, doc["live"][b]) for b in buckets if b in doc["live"]]
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The table as published; None if nothing was."""
        _, doc = self._manifest(spark)
        return self._rows(spark, doc, list(doc["live"])) if doc["schema"] else None

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(n)).cast("int")

    def merge(self, new: DataFrame, order: list[str] | None = None) -> dict:
        """Insert or replace whole rows by key (of several for a key the last by ``order``)."""
        return self._merge(new, order, self._replaced)

    def upsert(self, updates: DataFrame, order: list[str] | None = None) -> dict:
        """A key present takes every supplied column and keeps the others; new keys are inserted."""
        return self._merge(updates, order, self._updated)

    def _replaced(self, old: DataFrame, rows: DataFrame) -> DataFrame:
        u = rows.select(*[F.col(k).alias(f"__u_{k}") for k in self.keys])
        kept = old.join(u, [F.col(k).eqNullSafe(F.col(f"__u_{k}")) for k in self.keys], "left_anti")
        return kept.unionByName(rows, allowMissingColumns=True)

    def _updated(self, old: DataFrame, rows: DataFrame) -> DataFrame:
        supplied = [c for c in rows.columns if c not in self.keys]
        u = rows.select(*[F.col(k).alias(f"__u_{k}") for k in self.keys], *[F.col(c).alias(f"__u_{c}") for c in supplied], F.lit(True).alias("__upd"))
        j = old.withColumn("__old", F.lit(True)).join(u, [F.col(k).eqNullSafe(F.col(f"__u_{k}")) for k in self.keys], "full_outer")
        out = [F.when(F.col("__old"), F.col(k)).otherwise(F.col(f"__u_{k}")).alias(k) for k in self.keys]
        out += [F.when(F.col("__upd"), F.col(f"__u_{c}")).otherwise(F.col(c)).alias(c) if c in supplied else F.col(c) for c in old.columns if c not in self.keys]
        return j.select(*out)

    def _merge(self, new: DataFrame, order: list[str] | None, merged) -> dict:
        """Returns what was done: version, buckets rewritten, of how many."""
        spark, keys = new.sparkSession, list(self.keys)
        version, doc = self._manifest(spark)
        n = doc["buckets"]
        rows = TB.last_wins(new, keys, order).drop(*(order or []))
        # stored: the same rows name the buckets and go into them
        rows = materialize(rows.withColumn(_BUCKET, self._bucket(n)), "bucket-updates")
        touched = sorted(r[0] for r in rows.select(_BUCKET).distinct().collect())  # ``buckets`` numbers at most
        rows = rows.drop(_BUCKET)
        old = self._rows(spark, doc, [str(b) for b in touched]) if doc["schema"] else spark.createDataFrame([], rows.schema)
        for field in rows.schema.fields:  # columns that the table does not have yet
            if field.name not in old.columns:
                old = old.withColumn(field.name, F.lit(None).cast(field.dataType))
        out = merged(old, rows).select(*old.columns)
        generation = uuid.uuid4().hex
        # one task a bucket: no more files than buckets
        out.withColumn(_BUCKET, self._bucket(n)).repartition(max(1, len(touched)), _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/data/gen={generation}")
        live = doc["live"] | {str(b): generation for b in touched}
        MF.publish(spark, f"{self.path}/live", version + 1, {"buckets": n, "schema": old.schema.json(), "live": live})
        return {"version": version + 1, "rewritten": len(touched), "buckets": n}

    def vacuum(self, spark: SparkSession) -> int:
        """Delete bucket folders that no kept manifest names (not while a merge runs); returns how many."""
        folder = f"{self.path}/live"
        kept = {self._folder(b, g) for v in MF.versions(spark, folder) for b, g in MF.document(spark, folder, v)["live"].items()}
        gone = 0
        for g in sub_folders(spark, f"{self.path}/data"):
            names = sub_folders(spark, f"{self.path}/data/{g}")
            dead = [f"{self.path}/data/{g}/{b}" for b in names if f"{self.path}/data/{g}/{b}" not in kept]
            targets = [f"{self.path}/data/{g}"] if len(dead) == len(names) else dead
            for path in targets:
                if exists(spark, path):
                    file_system(spark, path).delete(hadoop_path(spark, path), True)
            gone += len(dead)
        return gone
