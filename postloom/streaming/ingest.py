"""Ingest: landing JSON -> normalize -> incremental filter -> dedupe -> posts / hashtags /
cursor / run log.  One function serves batch and Structured Streaming (X1-X6).

``ingest_batch`` is the ``foreachBatch`` body, one stream per platform.  Everything a batch
writes lies in folders named by the stream's run (its query id, which lives as long as its
checkpoint) and the batch, and counts once the batch's commit folder has its marker: a retried
batch replaces its own output, a fresh checkpoint is a new run and replaces nothing, and a
half-written batch is never read.  Only "no such folder" means "nothing stored yet"; any other
fault of the store is raised.

What a batch needs of all batches before it does not grow with them:

* Cursors and counters per (platform, query) are state of the stream (``with_progress``): the
  batch's lines are counted per task, the counts meet the state, and one row per touched query comes
  back, with the floor that the incremental filter uses and the names of the files its lines came in.
  The lines themselves never pass the state operator, so a busy query makes no busy task, and are not
  kept for the batch: it reads its files.  Each commit publishes the cursors of
  all queries of its platform as one small table, which batch runs and new checkpoints start from.
* Keys of stored posts lie in a bucketed key store per platform (``sources.keystore``), so the exact
  check against every committed batch shuffles the batch's keys only.
* One manifest per platform names the live key segments and the cursor table; publishing it is the
  last step.  One writer per platform at a time (a second one fails at publishing).

Times are taken per batch.  Duplicates are removed (1) inside the batch, first arrival wins, and
(2) against the key store, by (platform, post_id).  Posts are partitioned by platform and creation
date; posts whose creation time had to be imputed lie in a partition of their own.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom import config
from postloom.functions import text as T
from postloom.operators import filters as FL
from postloom.operators import normalize as NZ
from postloom.operators import sampling as SA
from postloom.operators import tables as TB
from postloom.session import COMPRESSION, committed, discard, mark_committed, materialize, scratch_path, shuffles_released, sub_folders
from postloom.sources import keystore as KS
from postloom.sources import manifest as MF
from postloom.sources import payloads as PL
from postloom.sources.schemas import POST_COLUMNS, POSTS, SCRAPER_STATE

STORED_POSTS = f"{POSTS}, created_at_imputed boolean, created_on string, run string, batch int"
CURSOR = ["platform", "query"]
SAMPLE = "platform string, post_id string, text string, created_at timestamp, sample_hash string"
SAMPLE_SEED = "pool"
IMPUTED = "imputed"
PART = "__part"
# Default files per micro-batch, so a batch stays bounded.
MAX_FILES_PER_TRIGGER = 1000
# Ids of this platform are numbers in order of time: its cursor is the last id.
ID_CURSOR = ("twitter",)


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.UTC)


@dataclass(frozen=True)
class Store:
    """Folder layout of the ingest tables (on shared storage): <table>/run=<run>/batch=<id>/...;
    progress/<platform> holds the manifest, keys/<platform> the key store (``buckets`` must not change).
    With ``sample`` each commit keeps a random sample of so many posts of the platform's pool (P1, R1)."""
    root: str
    buckets: int = KS.BUCKETS
    sample: int = 0

    def folder(self, table: str, run: str, batch: int) -> str:
        return f"{self.root}/{table}/run={run}/batch={batch}"

    def keys(self, platform: str) -> KS.KeyStore:
        return KS.KeyStore(f"{self.root}/keys/{platform}", buckets=self.buckets)

    def progress(self, spark: SparkSession, platform: str) -> tuple[int, dict]:
        """The platform's manifest: version, and {"segments": live key segments, "cursors": folder of the cursor table}."""
        if platform not in sub_folders(spark, f"{self.root}/progress"):
            return -1, {"segments": [], "cursors": None}
        version, document = MF.read(spark, f"{self.root}/progress/{platform}")
        return version, {"segments": [], "cursors": None} | document

    def cursors(self, spark: SparkSession, platform: str) -> DataFrame:
        """The platform's cursor table as last published."""
        folder = self.progress(spark, platform)[1]["cursors"]
        return spark.createDataFrame([], SCRAPER_STATE) if folder is None else spark.read.schema(SCRAPER_STATE).parquet(f"{self.root}/{folder}")

    def sampled(self, spark: SparkSession, platform: str) -> DataFrame | None:
        """The platform's sample: the first ``sample`` posts of the whole pool in seeded order, without reading the posts."""
        folder = self.progress(spark, platform)[1].get("sample")
        return None if folder is None else spark.read.schema(SAMPLE).parquet(f"{self.root}/{folder}")

    def committed(self, spark: SparkSession) -> list[tuple[str, int]]:
        """(run, batch) of every committed batch, from folder names and markers."""
        out = []
        for r in sub_folders(spark, f"{self.root}/commits"):
            for b in sub_folders(spark, f"{self.root}/commits/{r}"):
                if committed(spark, f"{self.root}/commits/{r}/{b}"):
                    out.append((r.removeprefix("run="), int(b.removeprefix("batch="))))
        return out

    def read(self, spark: SparkSession, table: str, batches: list[tuple[str, int]] | None = None) -> DataFrame | None:
        """A table over the given (by default all) committed batches; None without any."""
        batches = self.committed(spark) if batches is None else batches
        if not batches:
            return None
        r = spark.read.option("basePath", f"{self.root}/{table}")
        r = r.schema(STORED_POSTS) if table == "posts" else r  # a batch without new posts leaves no file to infer it from
        return r.parquet(*[self.folder(table, *b) for b in batches])


def normalized(lines: DataFrame, platform: str, as_of: dt.datetime) -> DataFrame:
    """Payload lines (value, query, arrival) of one platform in the posts layout, with their query and arrival."""
    raw = PL.parse_payloads(lines, platform, keep=("query", "arrival"))
    return NZ.NORMALIZERS[platform](raw, as_of, carry=("query", "arrival"))


def sifted(lines: DataFrame, platform: str, as_of: dt.datetime, floors: DataFrame | None) -> DataFrame:
    """The normalized lines with ``fresh``: neither rejected nor at or before the floor of their query.  A line that is
    neither fresh nor rejected is only counted, so its text and payload are left out; tags are found later, in what is stored."""
    rows, ok = normalized(lines, platform, as_of).drop("hashtags"), F.col("reject_reason").isNull()
    if floors is None:
        return rows.withColumn("fresh", ok)
    # one row per query against whole posts: the posts stay where they are, also those of a busy query
    if platform in ID_CURSOR:
        rows = FL.after_id(rows, F.broadcast(floors), CURSOR, flag="fresh")
    else:
        rows = FL.after_cursor(rows, F.broadcast(floors), CURSOR, keep_null_ts=True, flag="fresh").drop("had_cursor")
    needed = F.col("fresh") | ~ok
    return rows.withColumns({c: F.when(needed, F.col(c)) for c in ("text", "raw_json")} | {"fresh": F.col("fresh") & ok})


def _tagged(rows: DataFrame) -> DataFrame:
    """Rows with the tags of their texts, where the normalizers have them."""
    return rows.select(*[c for c, _ in POST_COLUMNS], T.hashtags("text").alias("hashtags"), *[c for c in rows.columns if c not in dict(POST_COLUMNS)])


def cursors(spark: SparkSession, store: Store) -> DataFrame | None:
    """The cursor of each (platform, query): one small table per platform, whatever the history."""
    out = None
    for platform in sub_folders(spark, f"{store.root}/progress"):
        one = store.cursors(spark, platform)
        out = one if out is None else out.unionAll(one)
    return out


def pinned(spark: SparkSession, store: Store, run: str, platform: str) -> DataFrame:
    """The cursors that stood when a run began, fixed at its first attempt: a retry must not skip
    posts because later batches have moved the cursor."""
    path = f"{store.root}/since/run={run}/platform={platform}"
    if not committed(spark, path):
        store.cursors(spark, platform).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.schema(SCRAPER_STATE).parquet(path)


# -- cursors and counters as state of the stream ------------------------------------------------

_PARTIAL = "platform string, query string, offered long, rejected long, newest_id string, newest_us long, files array<string>"
_STATE = "last_post_id string, last_us long, floor_id string, floor_us long, poll string, offered long, rejected long, batches long"
PROGRESS = f"platform string, query string, {_STATE}, files array<string>"  # the files are of the batch, no state


def _partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per (platform, query) of some rows: how many, how many rejected, the newest with a time of its own, and their files."""
    for f in frames:
        for (platform, query), g in f.groupby(["platform", "query"], dropna=False):
            timed = g[g["us"].notna()].sort_values(["us", "post_id"])
            last = timed.iloc[-1] if len(timed) else None
            yield pd.DataFrame({"platform": [platform], "query": [None if pd.isna(query) else query], "offered": [len(g)], "rejected": [int(g["rejected"].sum())],
                                "newest_id": [None if last is None else last["post_id"]],
                                "newest_us": pd.array([None if last is None else int(last["us"])], "Int64"), "files": [sorted(set(g["file"]))]})


def _value(x):
    return None if x is None or pd.isna(x) else x


def _advance(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """One (platform, query): its floor moves to its cursor when a new poll begins, its cursor only forward."""
    old = state.get if state.exists else None
    offered = rejected = 0
    newest, first, files = None, None, set()
    for f in frames:
        offered, rejected = offered + int(f["offered"].sum()), rejected + int(f["rejected"].sum())
        for r in f.itertuples(index=False):
            first = first or r
            files.update(r.files)
            if _value(r.newest_us) is not None:
                newest = max(newest or (int(r.newest_us), r.newest_id), (int(r.newest_us), r.newest_id))
    if old is None:  # a query that this checkpoint has not seen starts where the store's cursors stand
        last_id, last_us, n, bad, batches, floor_id, floor_us = _value(first.seed_id), _value(first.seed_us), 0, 0, 0, None, None
        last_us = None if last_us is None else int(last_us)
        poll = None
    else:
        last_id, last_us, floor_id, floor_us, poll, n, bad, batches = old
    if poll != first.poll:
        floor_id, floor_us, poll = last_id, last_us, first.poll
    if newest is not None and (last_us is None or newest[0] > last_us):
        last_us, last_id = newest
    now = (last_id, last_us, floor_id, floor_us, poll, n + offered, bad + rejected, batches + 1)
    state.update(now)
    names = [c.split()[0] for c in _STATE.split(", ")]
    yield pd.DataFrame({"platform": [key[0]], "query": [_value(key[1])]} | {
        c: pd.array([v], "Int64") if c in ("last_us", "floor_us") else [v] for c, v in zip(names, now, strict=True)} | {"files": [sorted(files)]})


def with_progress(lines: DataFrame, platform: str, seeds: DataFrame, poll: str) -> DataFrame:
    """For each query that a batch of the stream of lines touches, its progress and the files of its lines.

    ``seeds``: cursors for queries without state; ``poll`` names the run, floors move when it changes."""
    rows = normalized(lines, platform, dt.datetime(1970, 1, 1, tzinfo=dt.UTC))  # imputed times are no cursors, so this one counts for nothing
    slim = rows.select("platform", "query", "post_id", F.col("reject_reason").isNotNull().alias("rejected"),
                       F.when(~F.col("created_at_imputed") & F.col("reject_reason").isNull(), F.unix_micros("created_at")).alias("us"), F.col("arrival.file").alias("file"))
    own = seeds.select(*[F.col(c).alias(f"seed_{c}") for c in CURSOR], F.col("last_post_id").alias("seed_id"), F.unix_micros("last_timestamp").alias("seed_us"))
    same = [F.col(c).eqNullSafe(F.col(f"seed_{c}")) for c in CURSOR]
    counted = slim.mapInPandas(_partial, _PARTIAL).join(own, same, "left").drop(*[f"seed_{c}" for c in CURSOR])
    return counted.withColumn("poll", F.lit(poll)).groupBy(*CURSOR).applyInPandasWithState(_advance, PROGRESS, _STATE, "append", "NoTimeout")


def _floors(progress: DataFrame) -> DataFrame:
    return progress.select(*CURSOR, F.col("floor_id").alias("last_post_id"), F.timestamp_micros("floor_us").alias("last_timestamp"))


def ingest_batch(lines: DataFrame | None, platform: str, run: str, batch: int, store: Store, clock: Callable[[], dt.datetime] = utc_now,
                 floors: DataFrame | None = None, progress: DataFrame | None = None) -> None:
    """foreachBatch body: N5 quarantine, P4-P6 incremental filter, J4 in-batch first-wins, J3 against
    the key store, J10 tags, J9 + J7 cursors per (platform, query), X5 run log.

    ``floors``: the cursors that the incremental filter uses; None leaves the filter out.
    ``progress``: the stream's state of the touched queries; without it the cursors are advanced from
    the published ones.  ``lines`` None: those of the files that ``progress`` names.  A failure is logged with its reason and raised."""
    spark, as_of, began = (progress if lines is None else lines).sparkSession, clock(), time.monotonic()
    folder = lambda table: store.folder(table, run, batch)
    try:
        keys = store.keys(platform)
        version, live = store.progress(spark, platform)
        # a batch that is done again replaces itself: its own keys do not count as stored
        again = committed(spark, store.folder("commits", run, batch))
        own = materialize(store.read(spark, "posts", [(run, batch)]).select("post_id"), "own-keys") if again else None
        if lines is None:  # at most the files of a trigger, which the source lists on the driver too
            lines = PL.read_files(spark, sorted(r.file for r in progress.select(F.explode("files").alias("file")).distinct().collect()))
        rows = sifted(lines, platform, as_of, floors)
        day = F.when(F.col("created_at_imputed"), F.lit(IMPUTED)).otherwise(F.date_format("created_at", "yyyy-MM-dd"))
        # arrival order: landing-file time and name, then event time and payload as tie-breaks
        order = F.struct("arrival.mtime", "arrival.file", "created_at", F.md5("raw_json").alias("digest"))
        rows = rows.withColumns({"created_on": day, "arrival": order})
        # what is counted, ordered and refused is stored, without the texts of what is not refused: these are read from the files
        # once more, when they are written.  So no text lies beside its line and its post
        path = scratch_path(spark, "sifted")
        slim = materialize(rows.withColumns({c: F.when(F.col("reject_reason").isNotNull(), F.col(c)) for c in ("text", "raw_json")}), "sifted", path)
        try:
            fresh = slim.where("fresh")
            bad = slim.where("reject_reason is not null").drop("fresh", "arrival", "created_on")
            # a batch is of one platform, so the id alone is the key: the rows then lie as the key store's buckets do
            first = fresh.groupBy("post_id").agg(F.min("arrival").alias("arrival"))
            stored = keys.keys(spark, live["segments"])
            stored = stored if own is None else TB.new_only(stored, own, ["post_id"])
            behind = materialize(_other(fresh.select("post_id", "arrival"), first.join(stored, "post_id", "left_anti")).distinct(), "behind", f"{path}-behind")
            new = _other(rows.where("fresh"), behind).drop("reject_reason", "fresh")
            # query and tags go into the files too; readers of the posts table do not see them
            with shuffles_released(spark):
                dealt = _by_day(new, fresh)
                # a line that its file holds twice is left: its copies lie side by side
                one = Window.partitionBy("created_on", PART, "post_id").orderBy("arrival")
                dealt = dealt.withColumn("__rn", F.row_number().over(one)).where("__rn = 1").drop("__rn", PART, "arrival")
                _tagged(dealt).write.mode("overwrite").option("compression", COMPRESSION).partitionBy("platform", "created_on").parquet(folder("posts"))
            written = spark.read.schema(f"{STORED_POSTS}, query string, hashtags array<string>").parquet(folder("posts"))
            TB.hashtag_rows(written).write.mode("overwrite").parquet(folder("post_hashtags"))
            _tagged(bad).write.mode("overwrite").option("compression", COMPRESSION).parquet(folder("rejects"))
            segment = f"b{run}-{batch}"
            keys.add(written.select("post_id"), segment)
            # one group over what was offered, what passed the filter and what was saved
            kinds = ("offered", "rejected", "fresh", "saved")
            tally = lambda df, **of: df.select(*CURSOR, *[of.get(k, F.lit(0)).cast("long").alias(k) for k in kinds])
            counted = tally(slim, offered=F.lit(1), rejected=F.col("reject_reason").isNotNull(), fresh=F.col("fresh")).unionAll(
                tally(written, saved=F.lit(1)))
            counted = counted.groupBy(*CURSOR).agg(*[F.sum(k).alias(k) for k in kinds])
            log = counted.select(*CURSOR, "offered", "rejected", (F.col("offered") - F.col("rejected") - F.col("fresh")).alias("skipped"), "saved")
            _write_log(log, folder("run_log"), run, batch, "ok", None, as_of, began)
            document = {}
            if store.sample:
                pool = FL.pool_filter_sql(written).select("platform", "post_id", "text", "created_at")
                sketch, old = SA.sample_sketch(pool, store.sample, SAMPLE_SEED), store.sampled(spark, platform)
                document["sample"] = f"samples/{platform}/run={run}/batch={batch}-{uuid.uuid4().hex}"
                merged = sketch if old is None else SA.merge_sketches(old.unionByName(sketch), store.sample)
                merged.coalesce(1).write.parquet(f"{store.root}/{document['sample']}")
            table = f"cursors/{platform}/run={run}/batch={batch}-{uuid.uuid4().hex}"
            _moved(store.cursors(spark, platform), fresh, progress, as_of).coalesce(1).write.parquet(f"{store.root}/{table}")
        finally:
            discard(spark, path, f"{path}-behind")
        # the batch counts from here on
        mark_committed(spark, folder("commits"))
        segments, gone = keys.compact(spark, [s for s in live["segments"] if s[0] != segment])
        MF.publish(spark, f"{store.root}/progress/{platform}", version + 1, document | {"segments": [*segments, [segment, 0]], "cursors": table})
        keys.drop(spark, gone)
    except Exception as e:
        none = F.lit(None).cast("long")
        failed = spark.range(1).select(F.lit(platform).alias("platform"), F.lit(None).cast("string").alias("query"),
                                       *[none.alias(c) for c in ("offered", "rejected", "skipped", "saved")])
        _write_log(failed, f"{store.root}/failures/run={run}/batch={batch}/attempt={uuid.uuid4().hex}", run, batch, "failed",
                   f"{type(e).__name__}: {e}", as_of, began)
        raise


def _by_day(new: DataFrame, offered: DataFrame) -> DataFrame:
    """``new`` dealt out by creation day, so a batch writes about a file per day and task, not one per
    day in each task; a day with many posts is cut into as many parts as its share asks for (``PART``)."""
    tasks = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    days = offered.groupBy("created_on").agg(F.count("*").alias("__n"))
    share = F.col("__n") * tasks / F.sum("__n").over(Window.partitionBy(F.lit(0)))
    parts = days.select(F.col("created_on").alias("__day"), F.ceil(share).cast("int").alias("__parts"))
    dealt = new.join(F.broadcast(parts), F.col("created_on") == F.col("__day"), "left")
    part = F.pmod(F.xxhash64("post_id"), F.coalesce("__parts", F.lit(1)))
    return dealt.withColumn(PART, part).repartition(tasks, "created_on", PART).drop("__day", "__parts")


def _other(rows: DataFrame, some: DataFrame) -> DataFrame:
    """The ``rows`` whose (post_id, arrival) is not among ``some``; a busy post is spread by its arrivals."""
    kinds = ("mtime", "file", "created_at", "digest")
    s = some.select(F.col("post_id").alias("__id"), *[F.col(f"arrival.{k}").alias(f"__{k}") for k in kinds])
    return rows.join(s, [F.col("post_id").eqNullSafe(F.col("__id")), *[F.col(f"arrival.{k}").eqNullSafe(F.col(f"__{k}")) for k in kinds]], "left_anti")


def _moved(old: DataFrame, fresh: DataFrame, progress: DataFrame | None, as_of: dt.datetime) -> DataFrame:
    """J9 + J7: the platform's cursor table after a batch; cursors move forward only."""
    if progress is None:
        # an imputed time is no cursor: it would put every later post behind it
        newest = TB.newest_per_key(fresh.where(~F.col("created_at_imputed")), CURSOR, "post_id", "created_at")
    else:
        newest = progress.where("last_us is not null").select(*CURSOR, "last_post_id", F.timestamp_micros("last_us").alias("last_timestamp"))
    # matched null-safe: lines without a query have a cursor too
    o = old.select(*[F.col(c).alias(f"__o_{c}") for c in old.columns], F.lit(True).alias("__old"))
    j = o.join(newest, [F.col(f"__o_{c}").eqNullSafe(F.col(c)) for c in CURSOR], "full_outer")
    ahead = F.col("last_timestamp").isNotNull() & (F.col("__o_last_timestamp").isNull() | (F.col("last_timestamp") > F.col("__o_last_timestamp")))
    touched = F.col("last_timestamp").isNotNull()
    pick = lambda c: F.when(ahead, F.col(c)).otherwise(F.col(f"__o_{c}")).alias(c)
    return j.select(*[F.when(F.col("__old"), F.col(f"__o_{c}")).otherwise(F.col(c)).alias(c) for c in CURSOR], pick("last_post_id"), pick("last_timestamp"),
                    F.col("__o_cursor").alias("cursor"), F.when(touched, F.lit(as_of)).otherwise(F.col("__o_updated_at")).alias("updated_at"))


def _write_log(counts: DataFrame, path: str, run: str, batch: int, status: str, error: str | None, as_of: dt.datetime, began: float) -> None:
    counts.select(F.lit(run).alias("run_id"), F.lit(batch).cast("long").alias("batch_id"), "platform", "query", F.lit(status).alias("status"), "offered", "rejected",
                  "skipped", "saved", F.lit(as_of).alias("started_at"), F.lit(time.monotonic() - began).alias("elapsed_s"),
                  F.lit(error).cast("string").alias("error")).write.mode("overwrite").parquet(path)


def run_log(spark: SparkSession, store: Store) -> DataFrame | None:
    """Every run: committed batches (ok) and failed attempts."""
    ok = store.read(spark, "run_log")
    ok = None if ok is None else ok.drop("run", "batch")
    failed = None
    if sub_folders(spark, f"{store.root}/failures"):
        failed = spark.read.option("recursiveFileLookup", "true").parquet(f"{store.root}/failures")
    return ok if failed is None else failed if ok is None else ok.unionByName(failed)


def _poll(spark: SparkSession, folder: str) -> tuple[int, str]:
    """The run of polls that is open at a checkpoint, or a new one: a run that did not end is gone on with, so its floors stand."""
    version, last = MF.read(spark, folder)
    if last.get("open"):
        return version, last["poll"]
    poll = uuid.uuid4().hex
    MF.publish(spark, folder, version + 1, {"poll": poll, "open": True})
    return version + 1, poll


def run_ingest(spark: SparkSession, landing: dict[str, str], store: Store, checkpoint: str, clock: Callable[[], dt.datetime] = utc_now,
               available_now: bool = True, intervals: dict[str, int] | None = None, max_files: int | None = None,
               incremental: bool = True) -> dict:
    """One stream per platform, each with its checkpoint below ``checkpoint`` and, when
    polling, its own interval (minutes, ``config.POLL_INTERVALS`` by default).  ``available_now``
    processes what has landed and stops.  Returns the queries by platform.

    With ``incremental`` posts at or before the cursor that their (platform, query) had when the
    run began are skipped and counted.  A run that crashed, or was stopped while polling, is gone on
    with by the next call: its floors stand until a run with ``available_now`` has ended."""
    queries, polls = {}, {}
    for platform, path in landing.items():
        polls[platform] = _poll(spark, f"{checkpoint}/polls/{platform}")
        seeds = pinned(spark, store, polls[platform][1], platform)

        def body(df: DataFrame, batch: int, platform: str = platform) -> None:
            run = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            progress = df.persist()  # a row per touched query; the state operator runs once
            try:
                ingest_batch(None, platform, run, batch, store, clock, _floors(progress) if incremental else None, progress)
            finally:
                progress.unpersist()

        lines = with_progress(PL.stream_lines(spark, path, max_files or MAX_FILES_PER_TRIGGER), platform, seeds, polls[platform][1])
        w = lines.writeStream.option("checkpointLocation", f"{checkpoint}/{platform}").foreachBatch(body)
        minutes = (intervals or config.POLL_INTERVALS).get(platform, config.DEFAULT_POLL_MINUTES)
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{minutes} minutes")
        queries[platform] = w.start()
    if available_now:
        for platform, q in queries.items():
            q.awaitTermination()
            version, poll = polls[platform]
            MF.publish(spark, f"{checkpoint}/polls/{platform}", version + 1, {"poll": poll, "open": False})
    return queries


def ingest_once(spark: SparkSession, landing: dict[str, str], store: Store, run: str | None = None, clock: Callable[[], dt.datetime] = utc_now,
                incremental: bool = True) -> str:
    """Batch path: the same body over a plain read of the landing folders, as batch 0.. of a run;
    returns the run.  A repeated call with the same ``run`` replaces that run's output."""
    run = run or uuid.uuid4().hex
    for batch, (platform, path) in enumerate(landing.items()):
        floors = pinned(spark, store, run, platform) if incremental else None
        ingest_batch(PL.read_lines(spark, path), platform, run, batch, store, clock, floors)
    return run
