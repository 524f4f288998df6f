"""Tabular feature operators: imputation, one-hot levels, dictionary maps, bins, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def impute_mean(df: DataFrame, cols) -> DataFrame:
    """Fill nulls with the column mean over all rows (one-row aggregate, broadcast)."""
    means = F.broadcast(df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols]))
    out = df.crossJoin(means)
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}"))).drop(f"_m_{c}")
    return out


def levels(df: DataFrame, col: str, max_levels: int = 1000) -> list:
    """Sorted distinct non-null levels; refuses more than ``max_levels`` (a bound on
    what reaches the driver and on the number of output columns)."""
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"{col} has more than {max_levels} levels")
    return [r[0] for r in rows]


def one_hot(df: DataFrame, col: str, prefix: str | None = None, lvls=None, max_levels: int = 1000) -> DataFrame:
    """One 0/1 column per level (unmapped and null rows are all zeros); no shuffle."""
    prefix = prefix or col
    lvls = levels(df, col, max_levels) if lvls is None else lvls
    return df.select("*", *[F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{prefix}_{v}")
                            for v in lvls])


def map_values(col, mapping: dict):
    """Dictionary map as a literal map column; missing keys give null."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(m, F.col(col) if isinstance(col, str) else col)


def size_bins(size_col):
    """(single, small 2-4, large >= 5) flags."""
    s = F.col(size_col) if isinstance(size_col, str) else size_col
    return ((s == 1).cast("int").alias("single"), ((s >= 2) & (s <= 4)).cast("int").alias("small"),
            (s >= 5).cast("int").alias("large"))
