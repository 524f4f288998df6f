"""Deterministic keyed randomness.

Every random choice is ``md5(concat_ws('|', seed, key...))``: the same text in
Spark SQL and in DuckDB, independent of partitioning, retries and row order.
Never ``rand()`` (changes on task retry) and never Python ``hash()``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_hex(seed, *keys) -> Column:
    """32-char hex md5 of ``seed|key1|key2...`` (keys cast to string)."""
    parts = [F.lit(str(seed))] + [_as_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def hex_uniform(hex_col: Column, start: int = 1) -> Column:
    """Uniform [0, 1) from 8 hex digits of an md5 string."""
    return F.conv(F.substring(hex_col, start, 8), 16, 10).cast("bigint") / F.lit(TWO_32)


def uniform(seed, *keys) -> Column:
    return hex_uniform(hash_hex(seed, *keys))


def sql_hash_hex(seed, *keys: str) -> str:
    """DuckDB/Spark SQL text of :func:`hash_hex` (keys are SQL expressions)."""
    inner = ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"md5(concat_ws('|', {inner}))"


def sql_uniform(seed, *keys: str) -> str:
    return f"(('0x' || substr({sql_hash_hex(seed, *keys)}, 1, 8))::BIGINT / 4294967296.0)"
