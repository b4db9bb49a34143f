"""Copy-on-write by bucket: what a merge writes follows the update; readers see whole versions."""

import os

import pytest
from pyspark.sql import functions as F

from postloom.session import scratch_path
from postloom.sources import buckets as BK
from postloom.sources import manifest as MF


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def bytes_under(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path.removeprefix("file:")) for f in fs if f.endswith(".parquet"))


def test_merge_replaces_rows_and_upsert_keeps_columns(spark):
    t = BK.BucketTable(scratch_path(spark, "t-buckets"), ("k",), 8)
    assert t.read(spark) is None and t.version(spark) == -1
    t.merge(spark.createDataFrame([(1, "a", 1.0, 0), (2, "b", 2.0, 0), (None, "n", 0.0, 0), (2, "late", 3.0, 1)], "k int, v string, x double, at int"), ["at"])
    assert rows(t.read(spark)) == sorted([(1, "a", 1.0), (2, "late", 3.0), (None, "n", 0.0)], key=repr)
    t.merge(spark.createDataFrame([(2, "B", None), (3, "c", 9.0), (None, "N", 1.0)], "k int, v string, x double"))
    assert rows(t.read(spark)) == sorted([(1, "a", 1.0), (2, "B", None), (3, "c", 9.0), (None, "N", 1.0)], key=repr)
    t.upsert(spark.createDataFrame([(1, "A"), (4, "d"), (None, None)], "k int, v string"))
    assert rows(t.read(spark)) == sorted([(1, "A", 1.0), (2, "B", None), (3, "c", 9.0), (4, "d", None), (None, None, 1.0)], key=repr)
    t.upsert(spark.createDataFrame([(3, "new")], "k int, tag string"))  # a column the table lacks
    assert rows(t.read(spark)) == sorted([(1, "A", 1.0, None), (2, "B", None, None), (3, "c", 9.0, "new"), (4, "d", None, None), (None, None, 1.0, None)], key=repr)


def test_what_is_written_follows_the_update(spark):
    t = BK.BucketTable(scratch_path(spark, "t-bytes"), ("a", "b"), 32)
    big = spark.range(20000).select(F.col("id").alias("a"), F.lit("x").alias("b"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    t.merge(big)
    before = bytes_under(t.path)
    done = t.merge(spark.createDataFrame([(5, "x", "five"), (6, "y", "new")], "a long, b string, v string"))
    assert done["rewritten"] <= 2 and done["buckets"] == 32
    assert bytes_under(t.path) - before < 3 * before / 32
    assert t.read(spark).count() == 20001 and t.read(spark).where("a = 5").first().v == "five"


def test_a_writer_that_dies_before_publishing_changes_nothing(spark, monkeypatch):
    t = BK.BucketTable(scratch_path(spark, "t-dies"), ("k",), 4)
    t.merge(spark.createDataFrame([(i, "old") for i in range(20)], "k int, v string"))
    before = rows(t.read(spark))
    real = MF.publish

    def dies(*a):
        raise RuntimeError("power cut")

    monkeypatch.setattr(BK.MF, "publish", dies)
    with pytest.raises(RuntimeError):
        t.merge(spark.createDataFrame([(3, "new")], "k int, v string"))
    monkeypatch.setattr(BK.MF, "publish", real)
    assert rows(t.read(spark)) == before and t.version(spark) == 0
    t.merge(spark.createDataFrame([(3, "new")], "k int, v string"))
    after = [(i, "new" if i == 3 else "old") for i in range(20)]
    assert rows(t.read(spark)) == sorted(after, key=repr)
    # the dead writer's folder and replaced buckets of forgotten versions go
    for k in range(MF.KEEP + 1):
        t.merge(spark.createDataFrame([(3, f"v{k}")], "k int, v string"))
    assert t.vacuum(spark) >= 1
    assert {r[0]: r[1] for r in rows(t.read(spark))}[3] == f"v{MF.KEEP}" and t.read(spark).count() == 20


def test_a_second_writer_of_one_version_fails(spark, monkeypatch):
    t = BK.BucketTable(scratch_path(spark, "t-two"), ("k",), 4)
    t.merge(spark.createDataFrame([(1, "a")], "k int, v string"))
    real, seen = MF.publish, []

    def late(spark_, folder, version, document):
        if not seen:  # another writer is faster
            seen.append(1)
            t.merge(spark.createDataFrame([(1, "other")], "k int, v string"))
        return real(spark_, folder, version, document)

    monkeypatch.setattr(BK.MF, "publish", late)
    with pytest.raises(FileExistsError):
        t.merge(spark.createDataFrame([(1, "mine")], "k int, v string"))
    assert rows(t.read(spark)) == [(1, "other")]
