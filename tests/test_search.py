"""Evolution, sampled trials, and readers that keep every data row."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from tessera.operators import ml, neighbors
from tessera.sources import files


@pytest.mark.parametrize("kind", ["uniform", "one_point", "two_point"])
def test_evolution_finds_a_known_optimum_and_stops(kind):
    genes = [ml.Gene(-3, 5), ml.Gene(0, 20, integer=True), ml.Gene(1, 2)]
    calls = []

    def score(pop):
        calls.append(len(pop))
        return {i: (g[0] - 1) ** 2 + abs(g[1] - 13) + (g[2] - 1.5) ** 2 for i, g in enumerate(pop)}
    found = ml.evolve(score, genes, population=60, generations=120, mutation=0.2, crossover=kind, patience=25, seed=3)
    best = [min(s for t, _, _, s in found if t == turn) for turn in range(len(calls))]
    assert best[-1] < 0.15 and all(a >= b for a, b in zip(best, best[1:]))  # the best parent stays
    assert all(isinstance(g[1], int) and 0 <= g[1] <= 20 and -3 <= g[0] <= 5 and 1 <= g[2] <= 2 for _, _, g, _ in found)
    assert set(calls) == {60} and (len(calls) == 120 or best[-26] == best[-1])
    assert found == ml.evolve(score, genes, population=60, generations=120, mutation=0.2, crossover=kind, patience=25, seed=3)
    # parents are in the next population
    first, second = ({tuple(g) for t, _, g, _ in found if t == turn} for turn in (0, 1))
    assert len(first & second) >= 2


def test_crossover_exchanges_stretches():
    rng = random.Random(1)
    a, b = list("aaaaaaa"), list("bbbbbbb")
    for kind, most in (("one_point", 1), ("two_point", 2)):
        for _ in range(50):
            x, y = ml.cross(rng, a, b, kind)
            assert sum(p != q for p, q in zip(x, x[1:])) <= most and all({p, q} == {"a", "b"} for p, q in zip(x, y))
    with pytest.raises(ValueError):
        ml.cross(rng, a, b, "other")


def test_trials_do_not_depend_on_their_number_and_halve():
    space = {"a": ("log", 1e-4, 1.0), "b": ("range", -1, 1), "c": ["x", "y", "z"]}
    trials = ml.sampled_trials(space, 200)
    assert trials[:50] == ml.sampled_trials(dict(reversed(space.items())), 50)
    assert all(1e-4 <= t["a"] <= 1 and -1 <= t["b"] <= 1 for t in trials)
    assert 60 < sum(t["a"] < 1e-2 for t in trials) < 140 and {t["c"] for t in trials} == {"x", "y", "z"}
    rounds = []

    def score(some, fold):
        rounds.append((fold, len(some)))
        return [-abs(t["b"] - 0.3) for t in some]
    got = ml.halving_search(score, trials, k=4)
    assert rounds == [(0, 200), (1, 100), (2, 50), (3, 25)]
    assert trials[got[0][0]]["b"] == min((t["b"] for t in trials), key=lambda b: abs(b - 0.3)) and got[0][1] == 4
    assert len(got) == 200


def test_rows_equal_to_the_header_stay(spark, tmp_path):
    path = tmp_path / "t"
    path.mkdir()
    (path / "1.tsv").write_text("a\tb\n1\t2\na\tb\nx\n3\t4\t5\n")
    (path / "2.tsv").write_text("a\tb\na\tb\na\tb\n")
    (path / "3.tsv").write_text("7\t8\n")
    got = sorted((r["a"], r["b"]) for r in files.read_tsv_lenient(spark, str(path), ["a", "b"]).collect() if r["b"])
    assert got == [("1", "2"), ("7", "8"), ("a", "b"), ("a", "b"), ("a", "b")]


def test_vote_of_buckets_equals_that_of_all_pairs(spark, monkeypatch):
    """Pairs that share a bucket, without a row for each of them."""
    from pyspark.ml.feature import BucketedRandomProjectionLSHModel

    monkeypatch.setattr(BucketedRandomProjectionLSHModel, "approxSimilarityJoin", None)  # gave a row a pair
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 3) for _ in range(4)], i % 3) for i in range(90)]
    rows += [(100 + i, rows[i][1], 2) for i in range(20)] + rows[:9]  # copies, and rows given twice
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    q, r = df.where("id % 4 = 0"), df.where("id % 4 <> 0")
    got = {x["id"]: x["pred"] for x in ml.knn_vote(q, r, "id", "v", "label", bucket_length=1e6, num_tables=8, block=16).collect()}
    want = {}
    refs = {(i, tuple(v), c) for i, v, c in rows if i % 4}
    for i, v, _ in rows:
        if i % 4 == 0:
            near = [c for _, _, c in sorted((math.dist(v, u), j, c) for j, u, c in refs)[:3]]
            want[i] = min(set(near), key=lambda c: (-near.count(c), c))
    assert got == want


def test_visits_are_held_a_bounded_number_at_a_time(monkeypatch):
    class Frame:
        def mapInPandas(self, fn, schema):
            return list(fn([pd.DataFrame({"id": range(300), "vec": [np.array([i / 10, 1.0]) for i in range(300)], "q_part": 0})]))
    monkeypatch.setattr(neighbors, "VISITS", 64, raising=False)
    cells = {c: (50, 1.0) for c in range(4)}  # five blocks each
    frames = neighbors._visits(Frame(), np.array([[float(c), 0.0] for c in range(4)]), cells, True, 120, 10)
    assert sum(map(len, frames)) == 300 * 3 * 5 and max(map(len, frames)) <= 64


def test_a_ragged_line_is_split_once_for_all_its_members(spark, tmp_path):
    path = str(tmp_path / "groups")
    files.write_ragged_groups(spark.createDataFrame([(g, f) for g in (1, 2) for f in range(40)] + [(None, 5)], "gid long, fid long"), path)
    back = files.read_ragged_groups(spark, path)
    assert sorted((r["gid"], r["fid"]) for r in back.where("gid IS NOT NULL").collect()) == [(g, f) for g in (1, 2) for f in range(40)]
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and "split(" not in plan.split("Generate")[0]
