"""Group / block / pair plans over ``part`` (brand = function group, part = function)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import pairs as P
from tessera.operators.splits import group_blocks
from tessera.plans import sql as S
from tessera.plans.registry import query
from tessera.session import scratch_path
from tessera.sources import files
from tessera.sources.tables import Tables


def members_frame(t):
    p = t.part
    return p.select(F.regexp_extract("p_brand", "#([0-9]+)", 1).cast("bigint").alias("gid"),
                    F.col("p_partkey").alias("fid"))


def blocked(t):
    from tessera.session import materialize
    return materialize(group_blocks(members_frame(t), "gid", n_blocks=5, seed=42), "blocked_members")


@query("src_ragged_groups", f"SELECT gid, fid FROM ({S.MEMBERS})")
def q_src_ragged_groups(spark, sf):
    """Round trip through the ragged ``gid,f1,f2,...`` text format."""
    path = scratch_path(spark, "groups_csv")
    files.write_ragged_groups(members_frame(Tables(spark, sf)), path)
    return files.read_ragged_groups(spark, path)


@query("group_size_stats", f"""
WITH g AS (SELECT gid, count(fid) AS n FROM ({S.MEMBERS}) GROUP BY gid)
SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_members, min(n) AS min_size, max(n) AS max_size,
       round(avg(n), 6) AS avg_size, max(gid) AS max_gid FROM g""")
def q_group_size_stats(spark, sf):
    s = P.group_size_stats(members_frame(Tables(spark, sf)))
    return s.withColumn("avg_size", F.round("avg_size", 6))


@query("pos_pairs", f"WITH {S.PAIR_CTES} SELECT a, b, label FROM pos")
def q_pos_pairs(spark, sf):
    return P.positive_pairs(members_frame(Tables(spark, sf)), n_pos=1, seed=42)


@query("neg_pairs", f"WITH {S.PAIR_CTES} SELECT a, b, label FROM neg")
def q_neg_pairs(spark, sf):
    return P.negative_pairs(blocked(Tables(spark, sf)), n_neg=10, seed=42)


@query("set_difference", f"WITH {S.PAIR_CTES} SELECT DISTINCT a, b FROM draws")
def q_set_difference(spark, sf):
    """Drawn block candidates minus the anchor's own group."""
    return P.negative_draws(blocked(Tables(spark, sf)), n_neg=10, seed=42).select("a", "b").distinct()


@query("triplets", f"""
WITH {S.PAIR_CTES}
SELECT pos.a AS anchor, pos.b AS positive, neg.b AS hard_negative FROM pos JOIN neg ON pos.a = neg.a""")
def q_triplets(spark, sf):
    t = Tables(spark, sf)
    return P.triplets(P.positive_pairs(members_frame(t)), P.negative_pairs(blocked(t)))


@query("lookup_join", f"""
WITH {S.PAIR_CTES}, lk AS (SELECT p_partkey AS fid, p_name, p_type FROM part)
SELECT x.a, x.b, x.label, la.p_name AS p_name_a, la.p_type AS p_type_a, lb.p_name AS p_name_b, lb.p_type AS p_type_b
FROM (SELECT * FROM pos UNION ALL SELECT * FROM neg) x LEFT JOIN lk la ON x.a = la.fid LEFT JOIN lk lb ON x.b = lb.fid""")
def q_lookup_join(spark, sf):
    t = Tables(spark, sf)
    pairs = P.positive_pairs(members_frame(t)).unionByName(P.negative_pairs(blocked(t)))
    return P.attach_lookup(pairs, t.part, "p_partkey", ["p_name", "p_type"])


@query("group_partition_write", "SELECT p_partkey, p_brand, p_size FROM part")
def q_group_partition_write(spark, sf):
    """Rows appended by group into a bounded number of hash-bucket directories."""
    path = scratch_path(spark, "by_group")
    p = Tables(spark, sf).part.select("p_partkey", "p_brand", "p_size")
    files.write_by_group(p, path, "p_brand", n_buckets=8, file_rows=200)
    return spark.read.parquet(path).select("p_partkey", "p_brand", "p_size")
