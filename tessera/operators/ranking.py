"""Global and per-partition ranks without a one-partition window.

``hashed_rank`` gives the 0-based ``row_number`` of each row in the order
``(order_col, *tie_cols)`` within ``partition_cols``.  Rows are first placed in
buckets by a prefix of the (hex, uniformly distributed) order column, so the
window runs per bucket, in parallel; a bucket's offset is the prefix sum of
bucket counts, a table of at most ``16**bucket_chars`` rows per partition key.
The result equals ``row_number() OVER (PARTITION BY p ORDER BY order, ties) - 1``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys, how: str = "inner", small: bool = False) -> DataFrame:
    """Join on equal keys where null equals null, keeping the left side's key columns.
    ``small`` broadcasts the right side: only for tables with a proven bound."""
    keys = list(keys)
    r = right.select(*[F.col(c).alias(f"_key_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return left.join(F.broadcast(r) if small else r, cond, how).drop(*[f"_key_{k}" for k in keys])


def hashed_rank(df: DataFrame, order_col: str, tie_cols=(), partition_cols=(),
                out: str = "rank0", bucket_chars: int = 4) -> DataFrame:
    pcols = list(partition_cols)
    b = df.withColumn("_bkt", F.substring(F.col(order_col), 1, bucket_chars))
    keys = pcols + ["_bkt"]
    w = Window.partitionBy(*keys).orderBy(order_col, *tie_cols)
    ranked = b.withColumn("_rn", F.row_number().over(w))
    counts = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    prefix = Window.partitionBy(*pcols).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_cnt").over(prefix), F.lit(0)).alias("_off"))
    # without partition keys at most 16**bucket_chars rows: a proven bound, safe to broadcast
    return (join_null_safe(ranked, offsets, keys, small=not pcols)
            .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("bigint"))
            .drop("_bkt", "_rn", "_off"))


def sort_with_position(df: DataFrame, order_cols, out: str = "position") -> DataFrame:
    """Distributed sort plus a consecutive 0-based position column.

    The sort is range-partitioned (no single partition); the sorted rows are
    materialized once so partition ids are fixed, each partition's row count
    (a table of #partitions rows) gives its offset, and a row's position is
    its partition offset plus its index inside the partition.
    """
    from tessera.session import materialize
    s = df.orderBy(*order_cols).select("*", F.spark_partition_id().alias("_pid"),
                                       F.monotonically_increasing_id().alias("_mid"))
    s = materialize(s)
    cnt = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    offs = cnt.select("_pid", F.coalesce(F.sum("_c").over(Window.orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    within = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    # one row per partition: a proven bound
    return (s.join(F.broadcast(offs), "_pid")
            .withColumn(out, (F.col("_off") + within).cast("bigint"))
            .drop("_pid", "_mid", "_off"))


def largest_group(df: DataFrame, group_cols) -> int:
    """Rows in the largest group (one partial aggregate; a single number to the driver)."""
    r = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c")).first()[0]
    return int(r or 0)


def segmented_cumsum(df: DataFrame, group_cols, order_cols, value, out: str, n_sub: int = 256,
                     inclusive: bool = True, largest_group: int | None = None) -> DataFrame:
    """Running sum of ``value`` within each group in ``order_cols`` order (see
    :func:`segmented_cumsums`)."""
    return segmented_cumsums(df, group_cols, order_cols, {out: value}, n_sub, inclusive,
                             largest_group=largest_group)


def segmented_cumsums(df: DataFrame, group_cols, order_cols, values: dict, n_sub: int = 256,
                      inclusive: bool = True, agg: str = "sum", largest_group: int | None = None,
                      plain_max: int = 1 << 20) -> DataFrame:
    """Running sums of several values within each group in ``order_cols`` order,
    without sorting a whole group in one task.

    Each group's range of the first (numeric) order key is cut into ``n_sub``
    equal-width sub-ranges; running sums are computed per (group, sub-range) in
    parallel and shifted by the totals of the earlier sub-ranges (a table of at
    most ``n_sub + 1`` rows per group).  The sub-range is monotone in the key, so ties
    stay together and the result equals the plain per-group window.  A group
    holding a third of all rows is spread over ``n_sub`` tasks.  ``agg='max'``
    gives running maxima instead (null until a non-null value is seen).

    When the caller has checked the group sizes (``largest_group``, e.g. from
    :func:`largest_group` on the source table) and no group exceeds ``plain_max``
    rows, a plain per-group window is used; without a check the plan is segmented.
    """
    fn = {"sum": F.sum, "max": F.max}[agg]
    zero = F.lit(0) if agg == "sum" else F.lit(None)
    g = list(group_cols)
    key = order_cols[0]
    if not isinstance(key, str):
        raise ValueError("first order column must be a column name")
    names = list(values)
    if largest_group is not None and largest_group <= plain_max:
        # the caller checked the group sizes: no task sorts more than plain_max rows
        w = Window.partitionBy(*g).orderBy(*order_cols).rowsBetween(
            Window.unboundedPreceding, 0 if inclusive else -1)
        x = df
        for n in names:
            v = values[n]
            x = x.withColumn(n, F.coalesce(fn(F.col(v) if isinstance(v, str) else v).over(w), zero))
        return x
    st = df.groupBy(*g).agg(F.min(key).cast("double").alias("_lo"), F.max(key).cast("double").alias("_hi"))
    x = join_null_safe(df, st, g) if g else df.crossJoin(F.broadcast(st))
    span = F.col("_hi") - F.col("_lo")
    # a null key sorts first, as in the plain window
    sub = F.when(F.col(key).isNull(), F.lit(-1)).when(span > 0, F.least(F.floor((F.col(key).cast("double") - F.col("_lo")) / span * n_sub),
                                   F.lit(n_sub - 1))).otherwise(F.lit(0)).cast("int")
    # dealt by all keys: partitioned by the group alone, the window would be satisfied and
    # every sub-range of a group would stay in one task
    x = x.withColumn("_sub", sub).drop("_lo", "_hi").repartition(*g, "_sub")
    for i, n in enumerate(names):
        v = values[n]
        x = x.withColumn(f"_v{i}", F.col(v) if isinstance(v, str) else v)
    w = Window.partitionBy(*g, "_sub").orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    for i in range(len(names)):
        x = x.withColumn(f"_l{i}", F.coalesce(fn(f"_v{i}").over(w), zero))
    tot = x.groupBy(*g, "_sub").agg(*[fn(f"_v{i}").alias(f"_s{i}") for i in range(len(names))])
    before = Window.partitionBy(*g).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*g, "_sub", *[F.coalesce(fn(f"_s{i}").over(before), zero).alias(f"_o{i}")
                                    for i in range(len(names))])
    x = join_null_safe(x, offs, g + ["_sub"])
    for i, n in enumerate(names):
        comb = (F.col(f"_o{i}") + F.col(f"_l{i}")) if agg == "sum" else F.greatest(f"_o{i}", f"_l{i}")
        x = x.withColumn(n, comb)
    return x.drop("_sub", *[f"_{p}{i}" for p in "vlo" for i in range(len(names))])
