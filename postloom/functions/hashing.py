"""Seeded hash randomness shared by Spark and SQL oracles.

``u32(seed, key...)`` = first 8 hex digits of ``md5(seed|key...)`` as an integer
in [0, 2^32).  The same value is computable in DuckDB
(``('0x' || substr(md5(...), 1, 8))::BIGINT``), unlike ``rand()`` or
``xxhash64``, so every sampled operator keeps an exact SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash_hex(seed: str, *keys) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(k).cast("string") for k in keys]))


def u32(seed: str, *keys) -> Column:
    return F.conv(F.substring(hash_hex(seed, *keys), 1, 8), 16, 10).cast("long")


def unit(seed: str, *keys) -> Column:
    """Uniform double in [0, 1)."""
    return u32(seed, *keys) / F.lit(TWO_32)


def hash_prefix(seed: str, width: int, *keys) -> Column:
    """First ``width`` hex digits as an integer: the block id of the two-phase rank."""
    return F.conv(F.substring(hash_hex(seed, *keys), 1, width), 16, 10).cast("long")
