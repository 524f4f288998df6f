"""Order problems: rank of items inside a true order, percentile ranks, predicted
orders, order masks and the Kendall-style order score.

Positions travel as columns, never as list indexes: an order string is exploded
once with ``posexplode`` and everything after is joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_hex


def explode_order(orders: DataFrame, id_col: str = "id", order_col: str = "cell_order",
                  item_col: str = "cell_id", pos_col: str = "rank") -> DataFrame:
    """(id, 'c1 c2 c3') -> (id, item, 0-based position)."""
    return orders.select(id_col, F.posexplode(F.split(F.trim(F.col(order_col)), " +")).alias(pos_col, item_col))


def attach_rank(cells: DataFrame, orders: DataFrame, id_col="id", item_col="cell_id",
                order_col="cell_order") -> DataFrame:
    """Rank of each cell in its notebook's true order and rank / cell count.

    Orders are right-joined to the cells (a cell missing from its order string
    keeps a null rank); the count per id is a partial aggregate joined back.
    """
    pos = explode_order(orders, id_col, order_col, item_col, "rank")
    ranked = pos.join(cells, [id_col, item_col], "right")
    n = cells.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    from tessera.operators.ranking import join_null_safe
    return join_null_safe(ranked, n, [id_col]).withColumn("pct_rank", F.col("rank") / F.col("_n")).drop("_n")


def pct_rank_avg(df: DataFrame, partition_cols, value_col: str, out: str = "pct_rank",
                 largest_group: int | None = None) -> DataFrame:
    """Percentile rank with average ties, 1-based, divided by group size.

    Ranks are computed on the distinct values of each group (pre-aggregated),
    then joined back: ties collapse before anything is ordered.
    """
    from tessera.operators.ranking import join_null_safe, segmented_cumsum
    p = list(partition_cols)
    vals = df.groupBy(*p, value_col).agg(F.count(F.lit(1)).alias("_t"))
    # rows before each distinct value: a segmented running count over the distinct
    # values, so a huge group is not ranked by one task
    vals = segmented_cumsum(vals, p, [value_col], "_t", "_before", inclusive=False, largest_group=largest_group)
    n = vals.groupBy(*p).agg(F.sum("_t").alias("_n"))
    vals = join_null_safe(vals, n, p).select(*p, value_col, (F.col("_before") + (F.col("_t") + 1) / 2.0).alias("_avg"), "_n")
    keys = p + [value_col]
    cond = [df[k].eqNullSafe(vals[k]) for k in keys]
    j = df.join(vals, cond, "left")
    for k in keys:
        j = j.drop(vals[k])
    return j.withColumn(out, F.col("_avg") / F.col("_n")).drop("_avg", "_n")


def ordered_list(df: DataFrame, id_col: str, pos_col: str, item_col: str, out: str = "items") -> DataFrame:
    """Items of each id as an array ordered by position (ties by item)."""
    s = F.sort_array(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col(item_col).alias("v"))))
    return df.groupBy(id_col).agg(F.transform(s, lambda x: x["v"]).alias(out))


def predicted_position(df: DataFrame, id_col: str, score_col: str, item_col: str,
                       out: str = "pred_pos", largest_group: int | None = None) -> DataFrame:
    """0-based position of each item when its id's items are sorted by score (ties by
    item); a segmented count, so a huge notebook is not sorted in one task."""
    from tessera.operators.ranking import segmented_cumsum
    r = segmented_cumsum(df, [id_col], [score_col, item_col], F.lit(1), "_pos", largest_group=largest_group)
    return r.withColumn(out, (F.col("_pos") - 1).cast("int")).drop("_pos")


def inversion_counts(df: DataFrame, id_col: str, true_pos: str, pred_pos: str,
                     plain_max: int = 1 << 16, top_level: int = 15) -> DataFrame:
    """Per id: number of pairs ordered one way by ``true_pos`` and the other by ``pred_pos``.

    No pairs are formed.  A pair with ``pred_i > pred_j`` differs first at some bit
    L of the positions: there ``i`` has bit 1, ``j`` bit 0 and both share the
    prefix above L.  So per (id, L, prefix) a running count of bit-1 items in true
    order, read at each bit-0 item, counts every inversion exactly once:
    O(n log n) rows; the running counts are segmented (see ``segmented_cumsum``).
    """
    from tessera.operators.ranking import join_null_safe, segmented_cumsum
    from tessera.session import materialize
    df = materialize(df.select(id_col, true_pos, pred_pos), "positions")
    n = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    levels = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.col("_n"))).cast("int") - 1, F.lit(0)))
    x = (join_null_safe(df, n, [id_col])
         .select(id_col, F.col(true_pos).alias("_t"), F.col(pred_pos).cast("bigint").alias("_p"),
                 F.explode(levels).alias("_L")))
    x = x.select(id_col, "_t", "_L",
                 F.expr("shiftright(_p, _L + 1)").alias("_node"),
                 F.expr("shiftright(_p, _L) & 1").alias("_bit"))
    # dealt by all three keys, else every level of a notebook stays in the task of its id
    x = x.repartition(id_col, "_L", "_node")
    # running count per (id, level, prefix).  A node at level L holds at most
    # 2^(L+1) items: when the largest id is small (checked on the one-row max)
    # plain windows are bounded; otherwise levels >= top_level are segmented, so the top
    # levels (a whole notebook) are never sorted by one task
    w = (Window.partitionBy(id_col, "_L", "_node").orderBy("_t")
         .rowsBetween(Window.unboundedPreceding, -1))
    biggest = n.agg(F.max("_n")).first()[0] or 0
    if biggest <= plain_max:
        x = x.withColumn("_ones_before", F.coalesce(F.sum("_bit").over(w), F.lit(0)))
    else:
        low = x.where(F.col("_L") < top_level).withColumn("_ones_before", F.coalesce(F.sum("_bit").over(w), F.lit(0)))
        high = segmented_cumsum(x.where(F.col("_L") >= top_level), [id_col, "_L", "_node"], ["_t"], "_bit",
                                "_ones_before", inclusive=False)
        x = low.unionByName(high)
    inv = (x.where(F.col("_bit") == 0).groupBy(id_col)
           .agg(F.sum("_ones_before").cast("bigint").alias("inversions")))
    return join_null_safe(n, inv, [id_col], "left").select(
        id_col, F.coalesce("inversions", F.lit(0)).cast("bigint").alias("inversions"),
        F.col("_n").cast("bigint").alias("n"))


def kendall_tau(df: DataFrame, id_col: str, true_pos: str, pred_pos: str, plain_max: int = 1 << 16,
                top_level: int = 15) -> DataFrame:
    """``1 - 4 * sum(inversions) / sum(n (n - 1))`` over all ids (one row)."""
    inv = inversion_counts(df, id_col, true_pos, pred_pos, plain_max, top_level)
    return inv.agg(F.sum("inversions").alias("inversions"),
                   F.sum(F.col("n") * (F.col("n") - 1)).alias("total_2max")) \
        .withColumn("kendall_tau", 1 - 4 * F.col("inversions") / F.col("total_2max"))


def md_ratio(cells: DataFrame, id_col: str = "id", type_col: str = "cell_type",
             md_value: str = "markdown") -> DataFrame:
    """Per id: code count, markdown count and markdown share."""
    is_md = F.col(type_col) == md_value
    return (cells.groupBy(id_col)
            .agg(F.count_if(~is_md).alias("total_code"), F.count_if(is_md).alias("total_md"))
            .withColumn("md_ratio", F.col("total_md") / (F.col("total_md") + F.col("total_code"))))


def order_masks(cells: DataFrame, id_col="id", item_col="cell_id", pos_col="rank",
                type_col="cell_type", md_value="markdown", seed: int = 42,
                largest_group: int | None = None) -> DataFrame:
    """Per id: markdown mask in true order, a skeleton with code cells in place and
    the markdown cells dealt into the markdown slots in hashed order, the
    permutation used, and the markdown count."""
    from tessera.operators.ranking import hashed_rank, join_null_safe, segmented_cumsum
    md = cells.where(F.col(type_col) == md_value).withColumn("_h", hash_hex(seed, item_col))
    # slot = markdown index in true order (segmented count); deal = index in hashed
    # order (bucketed rank): neither sorts a whole notebook in one task
    slot = segmented_cumsum(md, [id_col], [pos_col, item_col], F.lit(1), "_slot",
                            largest_group=largest_group).withColumn(
        "_slot", F.col("_slot") - 1)
    deal = hashed_rank(md, "_h", [item_col], partition_cols=[id_col], out="_slot")
    dealt = join_null_safe(slot.select(id_col, F.col(item_col).alias("_slot_item"), "_slot"),
                           deal.select(id_col, "_slot", F.col(item_col).alias("_dealt")), [id_col, "_slot"])
    fill = join_null_safe(dealt, slot.select(id_col, F.col(item_col).alias("_dealt"), F.col("_slot").alias("_src")),
                          [id_col, "_dealt"])
    x = (join_null_safe(cells, fill.select(id_col, F.col("_slot_item").alias(item_col), "_dealt", "_slot", "_src"),
                        [id_col, item_col], "left")
         .withColumn("_is_md", (F.col(type_col) == md_value).cast("int"))
         .withColumn("_shown", F.coalesce("_dealt", item_col)))
    lists = x.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col("_is_md").alias("m"),
                                             F.col("_shown").alias("s")))).alias("_c"),
        F.sort_array(F.collect_list(F.when(F.col("_slot").isNotNull(),
                                           F.struct(F.col("_slot").alias("k"), F.col("_src").alias("v"))))).alias("_perm"),
        F.sum("_is_md").cast("bigint").alias("length"))
    return lists.select(id_col,
                        F.transform("_c", lambda e: e["s"]).alias("cell_shuffle"),
                        F.transform("_perm", lambda e: e["v"]).alias("permutation"),
                        F.transform("_c", lambda e: e["m"]).alias("md_mask"),
                        "length")
