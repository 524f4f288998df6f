"""Keyed n-gram masking, group writers, two-dimensional density."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import profile
from tessera.sources import files


def test_ngram_masking_keeps_its_budget_and_shares(spark):
    rows = [(i, [A.CLS_ID, *(1000 + (7 * i + k) % 900 for k in range(n)), A.SEP_ID, A.PAD_ID])
            for i in range(80) for n in [20 + i]] + [(900, []), (901, [A.CLS_ID, A.SEP_ID]), (902, [1001])]
    df = spark.createDataFrame(rows, "id long, ids array<int>")
    got = df.select("id", "ids", A.mask_ngrams_keyed("ids", "id", 1900).alias("m")).select("id", "ids", "m.*").collect()
    again = {r["id"]: r["m"] for r in df.repartition(7).select("id", A.mask_ngrams_keyed("ids", "id", 1900).alias("m")).collect()}
    masked = kept = other = n = runs = 0
    for r in got:
        free = [i for i, x in enumerate(r["ids"]) if x not in A.SPECIAL_IDS]
        hit = [i for i, x in enumerate(r["labels"]) if x != A.IGNORE_LABEL]
        assert set(hit) <= set(free) and all(r["labels"][i] == r["ids"][i] for i in hit)
        assert all(r["input_ids"][i] == x for i, x in enumerate(r["ids"]) if i not in hit)
        budget = max(1, round(0.15 * len(free))) if free else 0
        assert budget <= len(hit) <= budget + 2 or len(hit) == len(free)
        assert (again[r["id"]]["input_ids"], again[r["id"]]["labels"]) == (r["input_ids"], r["labels"])
        masked += sum(r["input_ids"][i] == A.MASK_ID for i in hit)
        kept += sum(r["input_ids"][i] == r["ids"][i] for i in hit)
        other += sum(r["input_ids"][i] not in (A.MASK_ID, r["ids"][i]) for i in hit)
        runs += sum(i - 1 not in hit for i in hit)
        n += len(hit)
        assert all(A.VOCAB_BASE <= r["input_ids"][i] < 1900 or r["input_ids"][i] == A.MASK_ID for i in hit)
    assert n > 600 and abs(masked / n - 0.8) < 0.05 and abs(kept / n - 0.1) < 0.04 and abs(other / n - 0.1) < 0.04
    assert 1.3 < n / runs < 2.2  # runs of one to three


def test_a_hot_group_has_several_writers_and_reads_prune(spark, tmp_path):
    rows = [("hot" if i % 3 == 0 else f"g{i % 40}" if i % 50 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(6)
    path = str(tmp_path / "groups")
    files.write_by_group(df, path, "g", n_buckets=8, file_rows=100)
    files.write_by_group(df.where("v < 0"), path, "g", n_buckets=8)  # nothing to append
    hot = files.read_group(spark, path, "g", "hot", n_buckets=8)
    assert sorted(r["v"] for r in hot.collect()) == [i for i in range(3000) if rows[i][0] == "hot"]
    assert len(hot.select(F.input_file_name().alias("f")).distinct().collect()) >= 5
    sizes = spark.read.parquet(path).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert sizes <= 300 and spark.read.parquet(path).count() == 3000
    assert len([d for d in os.listdir(path) if d.startswith("group_bucket=")]) <= 8
    plan = hot._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(group_bucket" in plan


def test_density_in_two_dimensions(spark):
    rng = np.random.default_rng(1)
    rows = [(f, "a", float(x), float(y)) for f in (None, "u") for x, y in rng.normal([3, 9], [1, 2], (400, 2))]
    rows += [("flat", "a", 1.0, float(i)) for i in range(5)] + [("u", "b", None, 1.0), ("u", "b", 2.0, 3.0)]
    df = spark.createDataFrame(rows, "f string, g string, x double, y double")
    got = profile.kde_2d(df, "x", "y", ["f", "g"], points=40).collect()
    assert {(r["f"], r["g"]) for r in got} == {(None, "a"), ("u", "a")} and len(got) == 2 * 40 * 40
    for f in (None, "u"):
        own = [r for r in got if r["f"] == f]
        pts = np.array([(x, y) for g, h, x, y in rows if g == f and h == "a"])
        bw = pts.std(axis=0, ddof=1) * len(pts) ** (-1 / 6)
        for r in own[::97]:
            u = (np.array([r["x"], r["y"]]) - pts) / bw
            exact = np.exp(-0.5 * (u ** 2).sum(axis=1)).sum() / (len(pts) * 2 * np.pi * bw.prod())
            assert r["density"] == pytest.approx(exact, rel=0.05, abs=5e-4)
    assert profile.kde_2d(df.where("x > 99"), "x", "y", "f").collect() == []


def test_density_of_more_hues_than_are_broadcast(spark):
    df = spark.createDataFrame([(h, float(i * (h + 1))) for h in range(6) for i in range(5)], "h int, x double")
    few = {(r["h"], r["gi"]): r["density"] for r in profile.kde_grid(df, "x", "h", points=5).collect()}
    many = {(r["h"], r["gi"]): r["density"] for r in profile.kde_grid(df, "x", "h", points=5, max_hues=3).collect()}
    assert len(few) == 30 and few.keys() == many.keys() and all(many[k] == pytest.approx(v) for k, v in few.items())
