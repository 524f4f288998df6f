"""Pair and triplet mining inside groups and blocks, without cross joins.

Members are ranked inside their group (and block) by a keyed hash; partners are
then *addressed* by rank, so every pair comes from an equi-join on
``(group, rank)`` or ``(block, slot)`` whose keys are unique per row: a group
holding a third of all rows still spreads evenly, and no step enumerates all
pairs of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_hex
from tessera.operators.ranking import hashed_rank, join_null_safe


def _ranked(df: DataFrame, part_col: str, id_col: str, seed: int, out: str) -> DataFrame:
    h = df.withColumn("_h", hash_hex(seed, id_col))
    r = hashed_rank(h, "_h", [id_col], partition_cols=[part_col], out=out)
    n = df.groupBy(part_col).agg(F.count(F.lit(1)).alias(f"{out}_n"))
    return join_null_safe(r.drop("_h"), n, [part_col])


def positive_pairs(members: DataFrame, gid: str = "gid", fid: str = "fid", n_pos: int = 1,
                   seed: int = 42) -> DataFrame:
    """For each member, the next ``n_pos`` members of its group on a hashed ring
    (label 1).  A one-member group yields nothing; ``n_pos`` is capped at size - 1."""
    r = _ranked(members.select(gid, fid), gid, fid, seed, "_r")
    steps = r.where(F.col("_r_n") > 1).select(
        gid, F.col(fid).alias("a"), "_r", "_r_n",
        F.explode(F.sequence(F.lit(1), F.least(F.lit(n_pos), F.col("_r_n") - 1))).alias("_k"))
    steps = steps.withColumn("_pr", F.pmod(F.col("_r") + F.col("_k"), F.col("_r_n")))
    partner = r.select(gid, F.col("_r").alias("_pr"), F.col(fid).alias("b"))
    return steps.join(partner, [gid, "_pr"]).select("a", "b", F.lit(1).alias("label"))


def negative_draws(members: DataFrame, gid: str = "gid", fid: str = "fid", block: str = "block",
                   n_neg: int = 10, seed: int = 42) -> DataFrame:
    """``3 * n_neg`` hashed draws per anchor among its block (with replacement),
    minus members of the anchor's own group: (a, b, draw)."""
    m = members.select(gid, fid, block)
    r = _ranked(m, block, fid, seed, "_s")
    draws = r.select(block, gid, F.col(fid).alias("a"), "_s_n",
                     F.explode(F.sequence(F.lit(0), F.lit(3 * n_neg - 1))).alias("draw"))
    u = F.conv(F.substring(hash_hex(seed + 1, "a", "draw"), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    draws = draws.withColumn("_s", F.floor(u * F.col("_s_n")).cast("bigint"))
    target = r.select(block, "_s", F.col(fid).alias("b"), F.col(gid).alias("_bg"))
    return (draws.join(target, [block, "_s"])
            .where(F.col("_bg") != F.col(gid))
            .select("a", "b", "draw"))


def negative_pairs(members: DataFrame, gid: str = "gid", fid: str = "fid", block: str = "block",
                   n_neg: int = 10, seed: int = 42) -> DataFrame:
    """Up to ``n_neg`` distinct other-group partners per anchor from its block (label 0)."""
    d = negative_draws(members, gid, fid, block, n_neg, seed)
    first = d.groupBy("a", "b").agg(F.min("draw").alias("draw"))
    # at most 3 * n_neg rows per anchor: a bounded window
    w = Window.partitionBy("a").orderBy("draw")
    return (first.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n_neg)
            .select("a", "b", F.lit(0).alias("label")))


def triplets(pos: DataFrame, neg: DataFrame) -> DataFrame:
    """(anchor, positive, hard negative): positives x negatives of the same anchor
    (both bounded per anchor, so the join is at most n_pos * n_neg per anchor)."""
    return pos.select(F.col("a").alias("anchor"), F.col("b").alias("positive")) \
        .join(neg.select(F.col("a").alias("anchor"), F.col("b").alias("hard_negative")), "anchor")


def attach_lookup(pairs: DataFrame, lookup: DataFrame, key: str, cols, suffixes=("_a", "_b")) -> DataFrame:
    """Attach per-id attributes to both ends of a pair (two equi-joins; AQE picks
    broadcast when the lookup's runtime size is small)."""
    out = pairs
    for side, suf in zip(("a", "b"), suffixes):
        lk = lookup.select(F.col(key).alias(side), *[F.col(c).alias(c + suf) for c in cols])
        out = out.join(lk, side, "left")
    return out


def group_size_stats(members: DataFrame, gid: str = "gid", fid: str = "fid") -> DataFrame:
    """#groups, #members, min/max/avg group size and max group id (two-level aggregate)."""
    g = members.groupBy(gid).agg(F.count(fid).alias("_n"))
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("_n").alias("n_members"),
                 F.min("_n").alias("min_size"), F.max("_n").alias("max_size"),
                 F.avg("_n").alias("avg_size"), F.max(gid).alias("max_gid"))
