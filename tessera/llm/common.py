"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: words are runs of anything but these six separators
SEPARATORS = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty), ``text_key`` and the named columns.

    Rows are addressed by ``(doc_id, text_key)``: rows repeated under one id with the
    same text are one document given twice, with another text they are another one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key"), *more)


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def spread(df: DataFrame) -> DataFrame:
    """A round-robin exchange where a scan gives fewer tasks than the cluster has cores
    (a small file is one task); larger inputs keep their splits and get no exchange."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
