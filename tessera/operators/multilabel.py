"""Balanced folds for many labels at once, the rarest label first.

A label is a value of a label column (null counts as one).  Every row belongs to the round
of its rarest label and, by a hash of its key, to one of ``buckets`` units of that round.
One aggregate counts the labels of every unit; from it the driver deals whole units, round
after round, to the fold that still lacks most of what a unit holds, a rare label weighing
more.  The demand that is left is a number a label and fold, and the aggregate has a row for a
unit and label at most, ``labels * buckets * labels``, however many rows there are.  Rows get
the fold of their unit by a join with that small table, without a shuffle of the rows by
anything but the size check of the join.

A fold depends on keys and labels alone, never on partitioning.  Rows of one key and one
set of labels share a fold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_hex
from tessera.session import materialize


def _labels(label_cols) -> Column:
    return F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("∅"))) for c in label_cols])


def deal(units: dict[tuple[int, int], dict[int, int]], totals: np.ndarray, k: int) -> dict[tuple[int, int], int]:
    """Fold of every unit.  ``units``: (round, bucket) -> count of each label; labels and
    rounds are numbered from the rarest."""
    wanted = np.repeat(totals[:, None] / k, k, axis=1).astype(float)
    out = {}
    by_round: dict[int, list] = {}
    for (turn, bucket), counts in units.items():
        by_round.setdefault(turn, []).append((bucket, counts))
    for turn in sorted(by_round):
        # the fullest unit first, so that small ones even out what is left
        for bucket, counts in sorted(by_round[turn], key=lambda x: (-x[1][turn], x[0])):
            at = np.fromiter(counts, dtype=np.int64)
            n = np.fromiter(counts.values(), dtype=float)
            lack = (wanted[at] * (n / totals[at] ** 2)[:, None]).sum(axis=0)
            fold = int(np.lexsort((np.arange(k), -np.round(lack, 12)))[0])
            wanted[at, fold] -= n
            out[turn, bucket] = fold
    return out


def iterative_kfold(df: DataFrame, key: str, label_cols, k: int = 5, seed: int = 42, buckets: int = 128,
                    fold_col: str = "kfold") -> DataFrame:
    """``df`` with a fold in which every label has about 1/k of its rows."""
    spark = df.sparkSession
    d = materialize(df.withColumn("_labels", _labels(label_cols)), "multilabel")
    sizes = d.select(F.explode("_labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = sorted(sizes, key=lambda r: (r["n"], r["label"]))  # a row a label
    if not sizes:
        return df.withColumn(fold_col, F.lit(None).cast("int"))
    numbers = F.broadcast(spark.createDataFrame([({r["label"]: i for i, r in enumerate(sizes)},)], "_no map<string, int>"))
    d = d.crossJoin(numbers).withColumn("_ids", F.transform("_labels", lambda x: F.element_at("_no", x))).drop("_no", "_labels")
    bucket = F.conv(F.substring(hash_hex(f"{seed}-fold", key), 1, 8), 16, 10).cast("long") % buckets
    d = d.withColumn("_round", F.array_min("_ids")).withColumn("_bucket", bucket.cast("int"))
    rows = (d.select("_round", "_bucket", F.explode("_ids").alias("no")).groupBy("_round", "_bucket", "no")
            .agg(F.count(F.lit(1)).alias("n")).toArrow())
    units: dict[tuple[int, int], dict[int, int]] = {}
    columns = (rows[c].to_pylist() for c in ("_round", "_bucket", "no", "n"))
    for turn, b, no, n in sorted(zip(*columns)):
        units.setdefault((turn, b), {})[no] = n
    folds = deal(units, np.array([r["n"] for r in sizes], dtype=float), k)
    table = spark.createDataFrame([(t, b, f) for (t, b), f in folds.items()], f"_round int, _bucket int, {fold_col} int")
    return d.join(F.broadcast(table), ["_round", "_bucket"]).select(*df.columns, fold_col)
