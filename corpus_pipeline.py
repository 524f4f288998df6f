"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on every row its predecessor kept.
All but the last return the columns of ``docs``; what a stage returns is written and read
again before the next one, so a lost executor repeats no earlier stage.  A null text is
rejected by the first stage; a row with a null doc_id passes the near-duplicate and the
benchmark stage; rows that repeat a doc_id stay or go together; an empty table passes
through as one.  Texts are taken whole, at any length; of near copies the smallest doc_id
stays; columns of any further names pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from tessera.llm.common import documents, remainder
from tessera.session import materialize


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with enough calibrated probability."""
    model = language_id.train(docs, remainder(F.col("doc_id"), 5) != 0)
    return language_id.keep_recognised(docs, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the later occurrences of lines that many sites carry."""
    out = line_dedup.remove_boilerplate(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies (five words, 0.8)."""
    gone = near_dedup.components(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, exact or edited."""
    gone = decontaminate.find_leaks(docs, documents(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", detect_language),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: classifier, MinHash, alignment and tokenizer have no SQL form; tests hold each stage to brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
