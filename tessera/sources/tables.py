"""The driver's parquet tables (one file or directory per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# tables whose rows carry long text: per-row work (regex, tokenizing) dominates,
# so a narrow scan is worth a round-robin spread
TEXT_TABLES = {"documents", "conversations", "pages", "benchmark"}

_SCAN_PARTS: dict[str, int] = {}


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Round-robin repartition when a scan yields fewer splits than the cluster has
    cores (a file with a single row group is read by one task).  Large inputs keep
    their native splits and get no extra shuffle; filters and column pruning still
    reach the scan below the repartition."""
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    have = _SCAN_PARTS.get(key) if key else None
    if have is None:
        have = df.rdd.getNumPartitions()
        if key:
            _SCAN_PARTS[key] = have
    return df.repartition(want) if have < want else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    df = spark.read.parquet(path)
    return spread(df, path) if name in TEXT_TABLES else df


class Tables:
    """Attribute access to the tables of one scale factor: ``t = Tables(spark, d); t.documents``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return table(self.spark, self.sf_dir, name)
