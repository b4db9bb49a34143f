"""Batch generation over request rows (G12) and the synthetic-post rows (S7 shape).

The model call itself is caller-supplied Python (an API client, a local
model); it runs inside ``mapInPandas`` over Arrow batches of one partition,
one request at a time, with a bounded number of attempts per request.  A
failure becomes a row with ``status = 'failed'`` and the error text instead of
failing the task, so a lost or retried task recomputes only its own rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators import tables as TB
from postloom.session import committed, materialize, sub_folders

RESULT_FIELDS = [
    ("text", "string"), ("model_family", "string"), ("cost_usd", "double"),
    ("input_tokens", "long"), ("output_tokens", "long"),
]


def batch_generate(requests: DataFrame, generate: Callable[[dict, int], dict], attempts: int = 3,
                   keep: list[str] | None = None, needs: list[str] | None = None) -> DataFrame:
    """Run ``generate(row, attempt) -> {text, model_family?, cost_usd?,
    input_tokens?, output_tokens?}`` for every request row.

    Output: the ``keep`` columns, the result fields, ``status`` (ok / failed),
    ``error`` (whole) and ``attempts`` used.  A result without ``text`` is a failure, and so is a
    request that lacks one of the columns it ``needs`` (0 attempts): no request is dropped."""
    keep = keep or [c for c in requests.columns]
    in_types = dict(requests.dtypes)
    schema = ", ".join([f"{c} {in_types[c]}" for c in keep] + [f"{n} {t}" for n, t in RESULT_FIELDS]
                       + ["status string", "error string", "attempts int"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                res, used = None, 0
                missing = [c for c in needs or () if pd.isna(row[c])]
                err = f"{missing[0]} is missing" if missing else None
                for attempt in range(1, 0 if missing else attempts + 1):
                    used = attempt
                    try:
                        res = generate(row, attempt)
                        if res and res.get("text") is not None:
                            err = None
                            break
                        err, res = "empty result", None
                    except Exception as e:  # noqa: BLE001 - recorded per row
                        err, res = f"{type(e).__name__}: {e}", None
                rec = {c: row[c] for c in keep}
                for n, _ in RESULT_FIELDS:
                    rec[n] = (res or {}).get(n)
                rec.update(status="ok" if res else "failed", error=err, attempts=used)
                out.append(rec)
            frame = pd.DataFrame(out, columns=keep + [n for n, _ in RESULT_FIELDS] + ["status", "error", "attempts"])
            for n, t in RESULT_FIELDS:
                if t == "long":
                    frame[n] = frame[n].astype("Int64")
            yield frame

    return requests.select(*keep).mapInPandas(run, schema)


WAVE_ROWS, CALLS_PER_TASK = 10_000, 100


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """Every row of the finished waves below ``ledger``; None if there is none."""
    done = [f"{ledger}/{w}" for w in sub_folders(spark, ledger) if committed(spark, f"{ledger}/{w}")]
    return spark.read.option("basePath", ledger).parquet(*done) if done else None


def generate_resumable(requests: DataFrame, generate: Callable[[dict, int], dict], ledger: str, key: str = "request_id",
                       wave_rows: int = WAVE_ROWS, calls_per_task: int = CALLS_PER_TASK, **options) -> DataFrame:
    """G12 with a request ledger: a run that was killed goes on where it stopped.

    Requests without an ``ok`` row in the ledger are dealt by a hash of their key into waves of about
    ``wave_rows``; each wave is one job that writes its results below ``ledger`` and counts once its
    marker is there.  So a killed run repeats the unfinished wave only, a lost task its own calls (about
    ``calls_per_task``, one after the other: the number of tasks bounds how many run at once), and a second
    run asks again only for what failed.  ``key`` is unique and not null.  Returns one row per request: its ok row,
    or its latest failure."""
    spark = requests.sparkSession
    before = read_ledger(spark, ledger)
    run = 0 if before is None else 1 + before.agg(F.max("run")).first()[0]
    open_ = requests if before is None else TB.new_only(requests, before.where("status = 'ok'"), [key])
    open_ = materialize(open_, "open-requests")
    n = open_.count()
    waves = -(-n // wave_rows)
    for wave in range(waves):
        mine = open_.where(F.pmod(F.xxhash64(key), F.lit(waves)) == wave).repartition(max(1, -(-min(n, wave_rows) // calls_per_task)))
        results = batch_generate(mine, generate, **options).withColumn("run", F.lit(run))
        results.write.parquet(f"{ledger}/wave={run:06d}-{wave:06d}-{uuid.uuid4().hex}")
    rows = read_ledger(spark, ledger)
    if rows is None:  # no request was ever made
        return batch_generate(requests, generate, **options).withColumn("run", F.lit(0)).limit(0)
    ok_first = rows.drop("wave").join(requests.select(key), key, "left_semi").withColumn("__ok", F.col("status") == "ok")
    return TB.last_wins(ok_first, [key], ["__ok", "run"]).drop("__ok")
