"""Raw payload sources (S1-S3): JSON lines in one landing folder per platform,
read in batch or as a stream; plus the parquet table scans (S4, S5).

Landing files are read as text and parsed beside the line, so the stored payload
is the line itself: keys that the schema does not know and lines that are no JSON
are kept as they came.  Below a platform's folder, ``query=<text>/`` sub-folders
(percent-encoded) name the query that fetched the posts.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.sources.schemas import POSTS, RAW

CORRUPT = "_corrupt_record"


def _lines(raw: DataFrame) -> DataFrame:
    """(value, query, arrival): arrival order is landing-file time and name."""
    path = F.col("_metadata.file_path")
    named = F.regexp_extract(path, "/query=([^/]*)/[^/]*$", 1)
    # the path is a URI, which encodes the folder's name, which encodes the query
    query = F.url_decode(F.url_decode(F.replace(named, F.lit("+"), F.lit("%2B"))))
    return raw.select("value", query.alias("query"), F.struct(F.col("_metadata.file_modification_time").alias("mtime"), path.alias("file")).alias("arrival")).where(
        F.length(F.trim("value")) > 0)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Batch read of one platform's landing folder: one row per line."""
    return _lines(spark.read.option("recursiveFileLookup", "true").text(path))


def read_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """The lines of some landing files, named by their URIs (as ``arrival`` does)."""
    paths = [re.sub(r"([{}\[\]*?\\])", r"\\\1", unquote(f)) for f in files]  # a path is a pattern
    raw = spark.read.option("recursiveFileLookup", "true").text(paths) if paths else None
    kind = "value string, query string, arrival struct<mtime: timestamp, file: string>"
    return spark.createDataFrame([], kind) if raw is None else _lines(raw)


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Streaming read of one platform's landing folder (new files only)."""
    r = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return _lines(r.text(path))


def parse_payloads(json_lines: DataFrame, platform: str, col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Payload lines in a column -> typed rows (missing keys -> NULL), with the whole line as
    ``raw_json``, ``malformed`` for a line that is no such JSON object, and the ``keep`` columns."""
    schema = f"{RAW[platform]}, {CORRUPT} string"
    p = F.from_json(F.col(col), schema, {"columnNameOfCorruptRecord": CORRUPT})
    parsed = json_lines.select(p.alias("p"), F.col(col).alias("raw_json"), *keep)
    bad = F.col("p").isNull() | F.col(f"p.{CORRUPT}").isNotNull()
    return parsed.select("p.*", "raw_json", bad.alias("malformed"), *keep).drop(CORRUPT)


def scan_posts(spark: SparkSession, path: str, folders: list[str] | None = None) -> DataFrame:
    """The stored posts table, or some of its folders (Catalyst prunes columns, pushes filters
    and leaves out the folders of other platforms and dates)."""
    return spark.read.schema(f"{POSTS}, created_on string").option("basePath", path).parquet(*(folders or [path]))


def scan_cleaned(spark: SparkSession, path: str) -> DataFrame:
    """Projected scan of the cleaned table, rows without text dropped."""
    return (spark.read.parquet(path).select("platform", "post_id", "original_text", "label", "split_group")
            .dropna(subset=["original_text"]))
