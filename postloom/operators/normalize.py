"""Platform normalizers (N1-N7): raw payload rows -> the common ``posts``
layout plus ``hashtags``, ``created_at_imputed`` and ``reject_reason``.

Each is one ``select`` of built-in expressions over a payload read with a
fixed schema (missing keys are NULL), so it runs inside whole-stage codegen.
Rows that cannot be stored are not dropped silently: ``split_rejects`` routes
them to a quarantine frame with their reason.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import text as T
from postloom.sources.schemas import POST_COLUMNS

OUT = [n for n, _ in POST_COLUMNS] + ["hashtags", "created_at_imputed", "reject_reason"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nonempty(c) -> Column:
    """NULL for NULL or ''."""
    x = _c(c)
    return F.when(x == "", F.lit(None)).otherwise(x)


def falsy_num(c) -> Column:
    """NULL for NULL or 0 (Python ``x or y`` on a number)."""
    x = _c(c)
    return F.when(x == 0, F.lit(None)).otherwise(x)


def parse_time(s, ingest_ts: Column) -> tuple[Column, Column]:
    """ISO-8601 text (``Z`` or offset, date only allowed) -> timestamp;
    empty or unparsable -> the ingest time.  Returns (timestamp, imputed flag)."""
    parsed = F.try_to_timestamp(nonempty(s))
    return F.coalesce(parsed, ingest_ts), parsed.isNull()


def _lit_ts(ingest_ts) -> Column:
    return F.lit(ingest_ts) if isinstance(ingest_ts, dt.datetime) else ingest_ts


def _finish(cols: dict[str, Column], scraped_at: Column, carry=()) -> list[Column]:
    cols.setdefault("scraped_at", scraped_at)
    cols.setdefault("sentiment", F.lit(None).cast("string"))
    cols.setdefault("category", F.lit(None).cast("string"))
    types = dict(POST_COLUMNS)
    out = []
    for n in OUT:
        c = cols[n]
        out.append((c.cast(types[n]) if n in types else c).alias(n))
    return out + [F.col(c) for c in carry]


def _payload(raw: DataFrame, carry) -> Column:
    """The payload as it came: the landing line where the source kept it, else the columns."""
    if "raw_json" in raw.columns:
        return F.col("raw_json")
    return F.to_json(F.struct(*[F.col(c) for c in raw.columns if c not in carry]))


def _reject(raw: DataFrame, reason: Column) -> Column:
    """A malformed line is rejected as such, before any other reason."""
    return F.when(F.col("malformed"), F.lit("malformed payload")).otherwise(reason) if "malformed" in raw.columns else reason


def normalize_twitter(raw: DataFrame, ingest_ts, carry=()) -> DataFrame:
    """N1.  Falsy fallbacks (``id_str`` -> ``id``, ``text`` -> ``full_text``,
    a 0 metric -> the legacy field); reply/repost/media flags are null-safe
    (a NULL or empty ``referenced_tweets`` keeps the post, flag false)."""
    ts = _lit_ts(ingest_ts)
    post_id = F.coalesce(nonempty("id_str"), F.col("id").cast("string"))
    text = F.coalesce(nonempty("text"), F.col("full_text"), F.lit(""))
    user = F.col("user")
    pm = F.col("public_metrics")
    username = F.coalesce(user["screen_name"], F.lit(""))
    created, imputed = parse_time("created_at", ts)
    first_ref = F.get(F.col("referenced_tweets"), 0)
    cols = {
        "post_id": post_id,
        "platform": F.lit("twitter"),
        "platform_url": F.concat(F.lit("https://twitter.com/"), username, F.lit("/status/"), post_id),
        "text": text,
        "language": F.coalesce(F.col("lang"), F.lit("unknown")),
        "author_id": F.coalesce(nonempty(user["id_str"]), user["id"].cast("string"), F.lit("")),
        "author_username": username,
        "author_display_name": F.coalesce(user["name"], F.lit("")),
        "author_followers": F.coalesce(user["followers_count"], F.lit(0)),
        "like_count": F.coalesce(falsy_num(pm["like_count"]), F.col("favorite_count"), F.lit(0)),
        "reply_count": F.coalesce(falsy_num(pm["reply_count"]), F.col("reply_count"), F.lit(0)),
        "retweet_count": F.coalesce(falsy_num(pm["retweet_count"]), F.col("retweet_count"), F.lit(0)),
        "view_count": F.coalesce(pm["impression_count"], F.lit(0)),
        "is_reply": F.col("in_reply_to_status_id").isNotNull() | F.col("in_reply_to_user_id").isNotNull(),
        "is_repost": F.col("retweeted_status").isNotNull() | F.coalesce(first_ref["type"] == "retweeted", F.lit(False)),
        "has_media": F.col("entities")["media"].isNotNull() | F.col("extended_entities").isNotNull(),
        "created_at": created,
        "raw_json": _payload(raw, carry),
        "hashtags": T.hashtags(text),
        "created_at_imputed": imputed,
        "reject_reason": _reject(raw, F.when(post_id.isNull() | (post_id == ""), F.lit("missing id"))),
    }
    return raw.select(*_finish(cols, ts, carry))


def normalize_reddit(raw: DataFrame, ingest_ts, carry=()) -> DataFrame:
    """N2.  ``title + "\\n\\n" + selftext`` when selftext is non-empty; no author ->
    ``[deleted]`` with 0 followers; followers = link + comment karma (0 if
    either is missing); media = not a self post; epoch seconds in UTC."""
    ts = _lit_ts(ingest_ts)
    title = F.coalesce(F.col("title"), F.lit(""))
    self_text = F.col("selftext")
    text = F.when(F.coalesce(self_text, F.lit("")) != "", F.concat(title, F.lit("\n\n"), self_text)).otherwise(title)
    author = F.col("author")
    name = F.when(author.isNull(), F.lit("[deleted]")).otherwise(F.coalesce(author["name"], F.lit("[deleted]")))
    karma = F.when(author.isNull(), F.lit(0)).otherwise(
        F.coalesce(author["link_karma"] + author["comment_karma"], F.lit(0)))
    created = F.coalesce(F.timestamp_micros((F.col("created_utc") * 1_000_000).cast("long")), ts)
    kept = F.to_json(F.struct("subreddit", "score", "url"))  # the fields that are stored of a reddit payload
    cols = {
        "post_id": F.col("id"),
        "platform": F.lit("reddit"),
        "platform_url": F.concat(F.lit("https://reddit.com"), F.coalesce(F.col("permalink"), F.lit(""))),
        "text": text,
        "language": F.lit("en"),
        "author_id": name,
        "author_username": name,
        "author_display_name": name,
        "author_followers": karma,
        "like_count": F.col("ups"),
        "reply_count": F.col("num_comments"),
        "retweet_count": F.lit(0),
        "view_count": F.lit(0),
        "is_reply": F.lit(False),
        "is_repost": F.lit(False),
        "has_media": ~F.coalesce(F.col("is_self"), F.lit(False)),
        "created_at": created,
        "raw_json": F.when(F.col("malformed"), F.col("raw_json")).otherwise(kept) if "malformed" in raw.columns else kept,
        "hashtags": T.hashtags(text),
        "created_at_imputed": F.col("created_utc").isNull(),
        "reject_reason": _reject(raw, F.when(F.coalesce(F.col("id"), F.lit("")) == "", F.lit("missing id"))),
    }
    return raw.select(*_finish(cols, ts, carry))


def normalize_bluesky(raw: DataFrame, ingest_ts, carry=()) -> DataFrame:
    """N3.  ``post_id`` = last segment of the URI (empty -> rejected); reply,
    repost (``reasonRepost`` in the reason type) and media flags are
    null-safe; first language tag, else ``unknown``."""
    ts = _lit_ts(ingest_ts)
    uri = F.coalesce(F.col("uri"), F.lit(""))
    post_id = F.when(uri == "", F.lit("")).otherwise(T.last_path_segment(uri))
    rec = F.col("record")
    author = F.col("author")
    text = F.coalesce(rec["text"], F.lit(""))
    handle = F.when(author.isNull(), F.lit("")).otherwise(F.coalesce(author["handle"], F.lit("")))
    created, imputed = parse_time(rec["created_at"], ts)
    embed = rec["embed"]
    cols = {
        "post_id": post_id,
        "platform": F.lit("bluesky"),
        "platform_url": F.concat(F.lit("https://bsky.app/profile/"), handle, F.lit("/post/"), post_id),
        "text": text,
        "language": F.coalesce(F.get(rec["langs"], 0), F.lit("unknown")),
        "author_id": F.when(author.isNull(), F.lit("")).otherwise(F.coalesce(author["did"], F.lit(""))),
        "author_username": handle,
        "author_display_name": F.when(author.isNull(), F.lit("")).otherwise(F.coalesce(author["display_name"], handle)),
        "author_followers": F.when(author.isNull(), F.lit(0)).otherwise(F.coalesce(author["followers_count"], F.lit(0))),
        "like_count": F.coalesce(F.col("like_count"), F.lit(0)),
        "reply_count": F.coalesce(F.col("reply_count"), F.lit(0)),
        "retweet_count": F.coalesce(F.col("repost_count"), F.lit(0)),
        "view_count": F.lit(0),
        "is_reply": F.coalesce(F.length(rec["reply"]) > 0, F.lit(False)),
        "is_repost": F.coalesce(F.col("reason")["py_type"].contains("reasonRepost"), F.lit(False)),
        "has_media": F.coalesce(embed["images"].isNotNull() | embed["external"].isNotNull(), F.lit(False)),
        "created_at": created,
        "raw_json": _payload(raw, carry),
        "hashtags": T.hashtags(text),
        "created_at_imputed": imputed,
        "reject_reason": _reject(raw, F.when(post_id == "", F.lit("empty post id"))),
    }
    return raw.select(*_finish(cols, ts, carry))


NORMALIZERS = {"twitter": normalize_twitter, "reddit": normalize_reddit, "bluesky": normalize_bluesky}


def normalize_any(frames: dict[str, DataFrame], ingest_ts) -> DataFrame:
    """Normalize each platform's payloads and union them; a platform
    without a normalizer yields one reject row per payload."""
    out = None
    for platform, raw in frames.items():
        fn = NORMALIZERS.get(platform)
        if fn is None:
            raw_json = _payload(raw, ())
            cols = {n: F.lit(None).cast(t) for n, t in POST_COLUMNS}
            cols.update(platform=F.lit(platform), raw_json=raw_json)
            part = raw.select(*[c.alias(n) for n, c in cols.items()],
                              F.array().cast("array<string>").alias("hashtags"),
                              F.lit(False).alias("created_at_imputed"),
                              F.lit(f"unknown platform {platform}").alias("reject_reason"))
        else:
            part = fn(raw, ingest_ts)
        out = part if out is None else out.unionByName(part)
    return out


def split_rejects(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows without ``reject_reason``, quarantined rows)."""
    ok = normalized.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = normalized.filter(F.col("reject_reason").isNotNull())
    return ok, bad
