"""A small versioned document on the store: what is live, published in one step.

``<folder>/v=<n>.json`` files are written aside and renamed, so a reader sees a whole version or
none, and of two writers of one version the second fails.  A few versions are kept; publishing
lists only those, whatever the history."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from postloom.session import exists, file_system, hadoop_path

KEEP = 3


def _write(spark: SparkSession, path: str, text: str) -> None:
    out = file_system(spark, path).create(hadoop_path(spark, path), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read(spark: SparkSession, path: str) -> str:
    stream = file_system(spark, path).open(hadoop_path(spark, path))
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Published versions that are still kept; none if the folder does not exist (any other fault is raised)."""
    if not exists(spark, folder):
        return []
    names = [s.getPath().getName() for s in file_system(spark, folder).listStatus(hadoop_path(spark, folder))]
    return sorted(int(n[2:-5]) for n in names if n.startswith("v=") and n.endswith(".json"))


def document(spark: SparkSession, folder: str, version: int) -> dict:
    return json.loads(_read(spark, f"{folder}/v={version}.json"))


def read(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """The latest version and its document; (-1, {}) if nothing was published."""
    found = versions(spark, folder)
    return (found[-1], document(spark, folder, found[-1])) if found else (-1, {})


def publish(spark: SparkSession, folder: str, version: int, document: dict) -> None:
    """Make ``document`` the given version, which must be new; versions before the last ``KEEP`` go."""
    fs, target, aside = file_system(spark, folder), f"{folder}/v={version}.json", f"{folder}/.{uuid.uuid4().hex}"
    _write(spark, aside, json.dumps(document))
    if exists(spark, target) or not fs.rename(hadoop_path(spark, aside), hadoop_path(spark, target)):
        fs.delete(hadoop_path(spark, aside), False)
        raise FileExistsError(f"version {version} of {folder} was published by another writer")
    for old in versions(spark, folder)[:-KEEP]:
        fs.delete(hadoop_path(spark, f"{folder}/v={old}.json"), False)
