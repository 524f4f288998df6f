"""Null groups, null strata, null order keys, masked groups; both sides of the size switches."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import oof, ordering, pooling, ranking, splits


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, None if i % 4 == 0 else f"g{i % 3}", None if i % 10 == 9 else i % 7) for i in range(100)],
                                 "id long, grp string, k long")


def test_ranks_keep_null_partitions(rows):
    h = rows.withColumn("h", F.md5(F.col("id").cast("string")))
    got = {(r["grp"], r["rank0"]) for r in ranking.hashed_rank(h, "h", ["id"], ["grp"]).collect()}
    assert len(got) == 100 and {(None, i) for i in range(25)} <= got


def test_stratified_folds_keep_null_strata(rows):
    got = splits.stratified_kfold(rows, "id", "grp", 5).collect()
    assert len(got) == 100
    for g in (None, "g0", "g1", "g2"):
        n = [sum(r["kfold"] == f and r["grp"] == g for r in got) for f in range(5)]
        assert max(n) - min(n) <= 1


@pytest.mark.parametrize("agg", ["sum", "max"])
def test_both_sides_of_the_size_switch_agree(rows, agg):
    def run(bound):
        d = ranking.segmented_cumsums(rows, ["grp"], ["k", "id"], {"out": "id"}, agg=agg, largest_group=bound, n_sub=4)
        return sorted((r["id"], r["out"]) for r in d.collect())
    assert run(None) == run(100) and len(run(None)) == 100


def test_percentile_ranks_keep_null_groups(rows):
    one, two = ([tuple(r) for r in ordering.pct_rank_avg(rows, ["grp"], "k", largest_group=b).orderBy("id").collect()]
                for b in (None, 100))
    assert one == two and len(one) == 100 and all(r[-1] is not None for r in one)


def test_fold_models_keep_null_groups(spark):
    d = spark.createDataFrame([(i, None if i % 2 else "a", i % 3, "t", float(i)) for i in range(12)],
                              "id int, grp string, kfold int, target string, y double")
    assert oof.fold_model_predictions(d, "grp", 3).count() == 36
    assert oof.fold_model_predictions(d, "grp", 3, own_fold_only=True).count() == 12
    got = {r["id"]: r["pred"] for r in oof.oof_group_mean(d, "grp").collect()}
    assert got[1] == pytest.approx((3 + 5 + 9 + 11) / 4)


def test_attach_rank_keeps_null_ids(spark):
    cells = spark.createDataFrame([("n", "c1"), (None, "c2")], "id string, cell_id string")
    orders = spark.createDataFrame([("n", "c1")], "id string, cell_order string")
    assert ordering.attach_rank(cells, orders).count() == 2


def test_pooling_of_masked_groups(spark):
    d = spark.createDataFrame([("a", [1.0, 2.0], 1), ("a", [3.0, 0.0], 1), ("a", [9.0, 9.0], 0), ("b", [5.0, 5.0], 0),
                               (None, [4.0, 6.0], 1)], "g string, v array<double>, m int")
    got = {how: {r["g"]: r["pooled"] for r in pooling.masked_pool(d, "g", "v", "m", how).collect()} for how in ("mean", "max", "min")}
    assert got["mean"] == {"a": [2.0, 1.0], "b": [0.0, 0.0], None: [4.0, 6.0]}
    assert got["max"] == {"a": [3.0, 2.0], "b": None, None: [4.0, 6.0]}
    assert got["min"] == {"a": [1.0, 0.0], "b": None, None: [4.0, 6.0]}
    both = {r["g"]: r["pooled"] for r in pooling.mean_max_pool(d, "g", "v", "m").collect()}
    assert both == {"a": [2.0, 1.0, 3.0, 2.0], "b": None, None: [4.0, 6.0, 4.0, 6.0]}
    att = {r["g"]: r["pooled"] for r in pooling.attention_pool(d, "g", "v", "m", [[0.0, 0.0]]).collect()}
    assert att == {"a": [2.0, 1.0], "b": None, None: [4.0, 6.0]}


def test_segments_are_dealt_over_tasks(spark, rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ranking.segmented_cumsums(rows, ["grp"], ["k"], {"out": "id"})._jdf.queryExecution().toString()
        assert "_sub" in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning" in x)
        kendall = ordering.inversion_counts(rows.select("grp", F.col("id").alias("t"), F.col("id").alias("p")), "grp", "t", "p")
        plan = kendall._jdf.queryExecution().toString()
        assert any("_node" in x for x in plan.split("\n") if "Exchange hashpartitioning" in x)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
