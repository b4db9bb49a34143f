"""Keyed-table operators: existence checks, first-arrival dedupe, upsert, cursor
merge, tag child rows, write-back, key checks.

All are equi-joins or keyed aggregates, so they shuffle on the key only.  "First"
and "last of a key" are ``row_number() = 1`` windows, which Spark plans with a
``WindowGroupLimit`` before the shuffle: each task keeps one row per key, so a key
holding a third of all rows still costs one row per task.

Inputs may repeat a key: of updates, predictions and new rows the last by their
order columns counts (all other columns where none is named), so no output row is
multiplied and ties do not depend on the run.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions import text as T


def new_only(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet (left anti join on the key)."""
    return incoming.join(stored.select(*keys), keys, "left_anti")


def _one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def _order(df: DataFrame, keys: list[str], order: list[str] | None) -> list[str]:
    """The order columns, then every other sortable column, so that ties have one result."""
    rest = [f.name for f in df.schema.fields if f.name not in keys and f.name not in (order or []) and f.dataType.typeName() not in ("map", "variant")]
    return [*(order or []), *rest]


def with_inserted_flag(incoming: DataFrame, stored: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Every offered row with ``inserted`` = its key was not stored and it is the first
    of its key in the batch (by ``order``)."""
    s = stored.select(*keys).distinct().withColumn("__hit", F.lit(True))
    w = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in _order(incoming, keys, order)] or [F.lit(0)])
    j = incoming.withColumn("__rn", F.row_number().over(w)).join(s, keys, "left")
    return j.withColumn("inserted", F.col("__hit").isNull() & (F.col("__rn") == 1)).drop("__hit", "__rn")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order`` (arrival)."""
    return _one_per_key(df, keys, [F.col(c) for c in order]).select(*keys, *[c for c in df.columns if c not in keys])


def last_wins(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key, the last by ``order``, then by the other columns."""
    columns = _order(df, keys, order)
    return _one_per_key(df, keys, [F.col(c).desc_nulls_last() for c in columns]) if columns else df.dropDuplicates(keys)


def upsert(stored: DataFrame, updates: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """A key present in ``updates`` takes every supplied column (NULL included);
    other columns keep the stored value; new keys are inserted.  Of several updates
    for a key the last by ``order`` counts; ``order`` columns are not stored."""
    updates = last_wins(updates, keys, order).drop(*(order or []))
    supplied = [c for c in updates.columns if c not in keys]
    u = updates.select(*keys, *[F.col(c).alias(f"__u_{c}") for c in supplied]).withColumn("__upd", F.lit(True))
    j = stored.withColumn("__old", F.lit(True)).join(u, keys, "full_outer")
    cols = [F.col(k) for k in keys]
    for c in stored.columns:
        if c in keys:
            continue
        if c in supplied:
            cols.append(F.when(F.col("__upd"), F.col(f"__u_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    extra = [F.col(f"__u_{c}").alias(c) for c in supplied if c not in stored.columns]
    return j.select(*cols, *extra)


def upsert_with_tags(stored: DataFrame, tags: DataFrame, updates: DataFrame, keys: list[str], text: str = "text",
                     order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """J6 with its child rows: (posts, tags).  Tags are written for inserted posts; those of
    an updated post stay as they are."""
    new = new_only(last_wins(updates, keys, order), stored, keys)
    rows = hashtag_rows(new, tuple(keys), text)
    return upsert(stored, updates, keys, order), tags.select(*rows.columns).unionByName(rows).distinct()


def cursor_merge(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str],
                 as_of: Column | dt.datetime) -> DataFrame:
    """A non-empty new field overwrites, empty or NULL keeps the old value;
    ``updated_at`` = ``as_of`` for touched keys."""
    a = F.lit(as_of) if isinstance(as_of, dt.datetime) else as_of
    o = old.select(*keys, *[F.col(f).alias(f"__o_{f}") for f in fields],
                   *([F.col("updated_at").alias("__o_updated_at")] if "updated_at" in old.columns else [F.lit(None).cast("timestamp_ntz").alias("__o_updated_at")]))
    n = new.select(*keys, *[F.col(f).alias(f"__n_{f}") for f in fields]).withColumn("__touched", F.lit(True))
    j = o.join(n, keys, "full_outer")

    def pick(f: str) -> Column:
        nv = F.col(f"__n_{f}")
        blank = nv.isNull() | (nv.cast("string") == "")
        return F.when(blank, F.col(f"__o_{f}")).otherwise(nv).alias(f)

    return j.select(*keys, *[pick(f) for f in fields],
                    F.when(F.col("__touched"), a).otherwise(F.col("__o_updated_at")).alias("updated_at"))


def newest_per_key(df: DataFrame, keys: list[str], id_col: str, ts: str) -> DataFrame:
    """The newest row of each key (ties by id) as the new cursor."""
    order = F.struct(F.col(ts), F.col(id_col))
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(F.col(id_col).cast("string").alias("last_post_id"), F.col(ts).alias("last_timestamp")),
                 order).alias("__c")).select(*keys, "__c.last_post_id", "__c.last_timestamp")


def advance_cursor(old: DataFrame, batch_newest: DataFrame, keys: list[str]) -> DataFrame:
    """Cursor moves only forward: keep the old one when the batch is older."""
    o = old.select(*keys, F.col("last_post_id").alias("__o_id"), F.col("last_timestamp").alias("__o_ts"))
    j = o.join(batch_newest, keys, "full_outer")
    fwd = F.col("__o_ts").isNull() | (F.col("last_timestamp").isNotNull() & (F.col("last_timestamp") > F.col("__o_ts")))
    return j.select(*keys,
                    F.when(fwd, F.col("last_post_id")).otherwise(F.col("__o_id")).alias("last_post_id"),
                    F.when(fwd, F.col("last_timestamp")).otherwise(F.col("__o_ts")).alias("last_timestamp"))


def hashtag_rows(posts: DataFrame, keys: tuple[str, ...] = ("platform", "post_id"), col: str = "text") -> DataFrame:
    """One child row per (key, tag), tags lower-cased then distinct."""
    return posts.select(*keys, F.explode(T.hashtag_keys(col)).alias("hashtag"))


def writeback(posts: DataFrame, predictions: DataFrame, keys: list[str], cols: list[str], order: list[str] | None = None) -> DataFrame:
    """A predicted value replaces the stored one; no prediction keeps it.  Of several
    predictions for a key the last by ``order`` counts."""
    last = last_wins(predictions.select(*keys, *cols, *[c for c in order or [] if c not in cols]), keys, order)
    p = last.select(*keys, *[F.col(c).alias(f"__p_{c}") for c in cols])
    j = posts.join(p, keys, "left")
    out = [F.coalesce(F.col(f"__p_{c}"), F.col(c)).alias(c) if c in posts.columns else F.col(f"__p_{c}").alias(c)
           for c in cols]
    return j.select(*[c for c in posts.columns if c not in cols], *out)


def key_violations(df: DataFrame, keys: list[Column | str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def prune_orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Keep child rows whose parent exists (left semi join)."""
    return child.join(parent.select(*keys), keys, "left_semi")


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """S8 core: insert-or-replace by key.  Of several new rows for a key the last by ``order``
    (arrival) counts.  Stored keys are unique, so the old rows need no window: those whose key
    is not in ``new`` stay."""
    last = last_wins(new, keys, order).drop(*[c for c in order or [] if c not in old.columns])
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)
