"""Deterministic splits: random, group, stratified and multi-label k-fold,
holdout by rows or by groups, and equal blocks of groups.

All randomness comes from ``md5(seed|key)``; every rank is a bucketed global
rank (:func:`tessera.operators.ranking.hashed_rank`), so no step funnels the
data through a single partition and results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_hex
from tessera.operators.ranking import hashed_rank


def _one_row_count(df: DataFrame, name: str = "_n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def random_kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42,
                 fold_col: str = "kfold") -> DataFrame:
    """Balanced random k-fold: fold sizes differ by at most one."""
    h = df.withColumn("_h", hash_hex(seed, key))
    r = hashed_rank(h, "_h", [key], out="_r")
    return r.withColumn(fold_col, (F.col("_r") % k).cast("int")).drop("_h", "_r")


def group_fold_table(df: DataFrame, group_col: str, k: int = 5, seed: int = 42,
                     fold_col: str = "kfold") -> DataFrame:
    """One row per distinct group with its fold (groups dealt round-robin in hashed order)."""
    g = df.select(group_col).where(F.col(group_col).isNotNull()).distinct()
    g = g.withColumn("_h", hash_hex(seed, group_col))
    r = hashed_rank(g, "_h", [group_col], out="_r")
    return r.select(group_col, (F.col("_r") % k).cast("int").alias(fold_col))


def group_kfold(df: DataFrame, group_col: str, k: int = 5, seed: int = 42,
                fold_col: str = "kfold") -> DataFrame:
    """Group k-fold: every group lands in exactly one fold (left join of fold flags).

    The fold table has one row per group; a hot group on the row side is split
    by AQE's skew-join handling rather than landing in one task.
    """
    return df.join(group_fold_table(df, group_col, k, seed, fold_col), group_col, "left")


def stratified_kfold(df: DataFrame, key: str, stratum_col: str, k: int = 5,
                     seed: int = 42, fold_col: str = "kfold") -> DataFrame:
    """Stratified k-fold: rows of a stratum dealt round-robin in hashed order.

    The deal continues across strata (offset = rows in earlier strata), which is
    the same as ``row_number() OVER (ORDER BY stratum, md5, key) mod k``: each
    stratum is spread evenly and overall fold sizes differ by at most one.
    """
    h = df.withColumn("_h", hash_hex(seed, key))
    r = hashed_rank(h, "_h", [key], partition_cols=[stratum_col], out="_r")
    sizes = df.groupBy(stratum_col).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy(F.col(stratum_col).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    # one row per stratum: the strata table is small by nature (class labels)
    offs = sizes.select(stratum_col, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    return (r.join(offs, r[stratum_col].eqNullSafe(offs[stratum_col]))
            .drop(offs[stratum_col])
            .withColumn(fold_col, ((F.col("_off") + F.col("_r")) % k).cast("int"))
            .drop("_h", "_r", "_off"))


def multilabel_kfold(df: DataFrame, key: str, label_cols, k: int = 5, seed: int = 42,
                     fold_col: str = "kfold", min_stratum: int | None = None) -> DataFrame:
    """Multi-label stratified k-fold, approximated by label-combination strata.

    Each row's stratum is the combination of all its label values; combinations
    with fewer than ``min_stratum`` (default ``k``) rows are pooled into one rare
    stratum.  Within a stratum rows are dealt round-robin, so every label value
    is spread over the folds as evenly as its combinations allow.
    """
    min_stratum = k if min_stratum is None else min_stratum
    combo = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in label_cols])
    d = df.withColumn("_combo", combo)
    sizes = d.groupBy("_combo").agg(F.count(F.lit(1)).alias("_cs"))
    d = (d.join(sizes, "_combo")
         .withColumn("_stratum", F.when(F.col("_cs") >= min_stratum, F.col("_combo")).otherwise(F.lit("~rare")))
         .drop("_combo", "_cs"))
    return stratified_kfold(d, key, "_stratum", k, seed, fold_col).drop("_stratum")


def holdout_split(df: DataFrame, key: str, frac: float = 0.9, seed: int = 42,
                  flag_col: str = "is_train") -> DataFrame:
    """Row holdout: the ``rint(frac*n)`` rows first in hashed order are train."""
    h = df.withColumn("_h", hash_hex(seed, key))
    r = hashed_rank(h, "_h", [key], out="_r")
    n = F.broadcast(_one_row_count(df))
    return (r.crossJoin(n)
            .withColumn(flag_col, F.col("_r") < F.rint(F.lit(frac) * F.col("_n")))
            .drop("_h", "_r", "_n"))


def group_holdout(df: DataFrame, group_col: str, frac: float = 0.9, seed: int = 42,
                  flag_col: str = "is_train") -> DataFrame:
    """Holdout by groups: a share ``frac`` of the *groups* is train."""
    g = df.select(group_col).where(F.col(group_col).isNotNull()).distinct()
    flags = holdout_split(g, group_col, frac, seed, flag_col)
    return df.join(flags, group_col, "left")


def group_blocks(df: DataFrame, group_col: str, n_blocks: int = 100, seed: int = 42,
                 block_col: str = "block") -> DataFrame:
    """Shuffle groups into ``n_blocks`` blocks whose group counts differ by at most one."""
    g = df.select(group_col).where(F.col(group_col).isNotNull()).distinct()
    g = g.withColumn("_h", hash_hex(seed, group_col))
    r = hashed_rank(g, "_h", [group_col], out="_r")
    n = F.broadcast(_one_row_count(g))
    blocks = (r.crossJoin(n)
              .select(group_col, F.floor(F.col("_r") * n_blocks / F.col("_n")).cast("int").alias(block_col)))
    return df.join(blocks, group_col, "left")


def fold_slice(df: DataFrame, fold: int, fold_col: str = "kfold"):
    """(train, valid) for one fold; pushed down / partition-pruned when stored by fold."""
    return df.where(F.col(fold_col) != fold), df.where(F.col(fold_col) == fold)
