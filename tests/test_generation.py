"""Resumable generation: finished requests are not asked again."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from postloom.operators import generation as GE
from postloom.session import scratch_path


def caller(folder, bad=()):
    """A model function that notes each call as a file."""
    def generate(row, attempt):
        os.makedirs(folder, exist_ok=True)
        open(f"{folder}/{row['request_id']}-{uuid.uuid4().hex}", "w").close()
        if row["request_id"] in bad:
            raise RuntimeError("refused")
        return {"text": f"text {row['request_id']}", "cost_usd": 0.5}

    return generate


def calls(folder):
    out = {}
    for f in os.listdir(folder) if os.path.isdir(folder) else []:
        k = int(f.split("-")[0])
        out[k] = out.get(k, 0) + 1
    return out


def test_a_killed_run_goes_on(spark, tmp_path, monkeypatch):
    requests = spark.range(40).select(F.col("id").alias("request_id"), F.lit("p").alias("prompt"))
    ledger, seen = scratch_path(spark, "t-ledger"), str(tmp_path / "calls")
    real, waves = GE.batch_generate, []

    def killed(df, generate, **options):
        waves.append(1)
        if len(waves) == 3:
            raise KeyboardInterrupt
        return real(df, generate, **options)

    monkeypatch.setattr(GE, "batch_generate", killed)
    with pytest.raises(KeyboardInterrupt):
        GE.generate_resumable(requests, caller(seen), ledger, wave_rows=10)
    monkeypatch.setattr(GE, "batch_generate", real)
    first = calls(seen)
    assert 0 < len(first) < 40
    # a wave that died while writing has no marker and does not count
    spark.range(3).select(F.col("id").alias("request_id"), F.lit("ok").alias("status"), F.lit(0).alias("run")).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{ledger}/wave=half")
    out = GE.generate_resumable(requests, caller(seen), ledger, wave_rows=10).collect()
    assert calls(seen) == dict.fromkeys(range(40), 1)
    assert sorted(r.request_id for r in out) == list(range(40)) and {r.status for r in out} == {"ok"}


def test_failures_are_asked_again_and_nothing_else(spark, tmp_path):
    requests = spark.range(12).select(F.col("id").alias("request_id"))
    ledger, one, two = scratch_path(spark, "t-failures"), str(tmp_path / "1"), str(tmp_path / "2")
    out = {r.request_id: r for r in GE.generate_resumable(requests, caller(one, bad={2, 5}), ledger, wave_rows=5, attempts=2).collect()}
    assert calls(one)[2] == 2 and calls(one)[0] == 1 and out[5].status == "failed" and out[5].run == 0
    out = {r.request_id: r for r in GE.generate_resumable(requests, caller(two, bad={5}), ledger, wave_rows=5, attempts=2).collect()}
    assert calls(two) == {2: 1, 5: 2} and out[2].text == "text 2" and out[5].status == "failed" and out[5].run == 1 and len(out) == 12
    more = spark.range(14).select(F.col("id").alias("request_id"))
    assert GE.generate_resumable(more, caller(two), ledger).where("status = 'ok'").count() == 14
    assert GE.generate_resumable(spark.range(0).select(F.col("id").alias("request_id")), caller(two), scratch_path(spark, "t-none")).count() == 0
