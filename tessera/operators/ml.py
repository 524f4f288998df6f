"""Modelling jobs on Spark ML: fold training with out-of-fold tables, test-time
fold averaging, classifier bake-off, nearest neighbours, importances, feature
elimination, configuration search and evolutionary weight search.

Driver loops are bounded by the number of folds / trials / generations; every
fit and every score is a distributed Spark job.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       NaiveBayes, RandomForestClassifier)
from pyspark.ml.feature import BucketedRandomProjectionLSH, HashingTF, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.session import materialize


NUM_FEATURES = 1024
#: rows whose dense features a task holds at a time
BLOCK_ROWS = 512


def _text_rows(df: DataFrame, keep, tokens_col: str, numeric_cols) -> DataFrame:
    """Columns ``keep`` and, written once for all folds, ``_x``: hashed term frequencies and the numeric columns."""
    df = df.withColumn("_t", F.coalesce(tokens_col, F.array().cast("array<string>")))
    tf = HashingTF(inputCol="_t", outputCol="_tf", numFeatures=NUM_FEATURES).transform(df)
    numeric = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in numeric_cols]
    rows = materialize(tf.select(*keep, "_tf", F.array(*numeric).cast("array<double>").alias("_n")), "text-rows")
    return rows.select(*keep, F.concat(vector_to_array("_tf"), "_n").alias("_x"))


def _blocks(batches, width: int):
    """Parts of Arrow batches whose first column is ``_x``, with it as a matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            yield part, part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _fold_moments(rows: DataFrame, targets, fold_col: str, width: int):
    """{fold: (products, documents with each feature)}: sums over a fold's rows of the products of the
    features, a one and the targets, from one pass.  Rows without a fold or a number are left out."""
    size = width + 1 + len(targets)

    def run(batches):
        sums: dict = {}
        for part, x in _blocks(batches, width):
            y = np.column_stack([part.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(targets))]).astype(float)
            folds = part.column(1).fill_null(-1).to_numpy()
            whole = np.column_stack([x, np.ones(len(x)), y])
            fine = np.isfinite(whole).all(axis=1) & (folds >= 0)
            for f in np.unique(folds[fine]):
                own = whole[fine & (folds == f)]
                have = sums.setdefault(int(f), np.zeros((size + 1, size)))
                have[:size] += own.T @ own
                have[size] += (own != 0).sum(axis=0)
        for f, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()),
                                              pa.array(list(m), pa.list_(pa.float64()))], names=["fold", "i", "v"])

    def add(part):  # a row of one fold's products, from every task
        v = np.sum(part.column("v").combine_chunks().flatten().to_numpy().reshape(-1, size), axis=0)
        return pa.table({"fold": part.column("fold")[:1], "i": part.column("i")[:1], "v": pa.array([v], pa.list_(pa.float64()))})

    schema = "fold int, i int, v array<double>"
    given = rows.select("_x", F.col(fold_col).cast("int").alias("_f"), *[F.col(t).cast("double").alias(t) for t in targets])
    got = given.mapInArrow(run, schema).groupBy("fold", "i").applyInArrow(add, schema).toArrow()
    out: dict = {}
    for f, i, v in zip(got["fold"].to_pylist(), got["i"].to_pylist(), got["v"]):
        out.setdefault(f, np.zeros((size + 1, size)))[i] = v.values.to_numpy()
    return out


def _ridge(moments: np.ndarray, width: int, target: int, reg: float) -> tuple[np.ndarray, float]:
    """Weights of the raw features and intercept of a ridge regression on TF-IDF and numeric features,
    standardized features and target as in Spark ML's normal solver."""
    m, seen = moments[:-1], moments[-1]
    n, y = m[width, width], width + 1 + target
    if not n:
        return np.full(width, np.nan), float("nan")
    idf = np.ones(width)
    idf[:NUM_FEATURES] = np.log((n + 1) / (seen[:NUM_FEATURES] + 1))
    mean, mean_y = m[width, :width] / n, m[width, y] / n
    cov = (m[:width, :width] / n - np.outer(mean, mean)) * np.outer(idf, idf)
    cov_y, var_y = (m[:width, y] / n - mean * mean_y) * idf, m[y, y] / n - mean_y ** 2
    var = np.diag(cov).copy()
    var[var <= 1e-12 * (mean * idf) ** 2] = 0
    if var_y <= 1e-14 * mean_y ** 2:
        return np.zeros(width), mean_y
    some = np.flatnonzero(var)
    std, std_y = np.sqrt(var[some]), var_y ** 0.5
    a = cov[np.ix_(some, some)] / np.outer(std, std) + reg / std_y * np.eye(len(some))
    b = cov_y[some] / (std * std_y)
    w = np.zeros(width)
    w[some] = (np.linalg.solve(a, b) if reg else np.linalg.lstsq(a, b, rcond=None)[0]) * std_y / std * idf[some]
    return w, mean_y - float(w @ mean)


def _fit(rows: DataFrame, targets, fold_col: str, width: int, folds, reg: float) -> dict:
    """{(fold, target): (weights, intercept)} of the models fitted on the other folds: one pass over the rows
    gives each fold's sums, the driver holds a matrix of the features a fold."""
    parts = _fold_moments(rows, targets, fold_col, width)
    size = width + 1 + len(targets)
    total = sum(parts.values(), np.zeros((size + 1, size)))
    return {(f, t): _ridge(total - parts.get(f, 0), width, i, reg) for f in folds for i, t in enumerate(targets)}


def cv_regression(df: DataFrame, key: str, targets, tokens_col: str, numeric_cols, k: int = 5,
                  fold_col: str = "kfold", reg: float = 0.1, max_folds: int | None = None):
    """Train one regressor per fold and target; return the long OOF table
    (key, kfold, target, y, pred).  ``max_folds`` stops early after n folds."""
    folds, width = range(k if max_folds is None else min(k, max_folds)), NUM_FEATURES + len(numeric_cols)
    rows = _text_rows(df, [key, fold_col, *targets], tokens_col, numeric_cols)
    models = _fit(rows, targets, fold_col, width, folds, reg)

    def run(batches):
        for part, x in _blocks(batches, width):
            at, pred = part.column(1).to_numpy(), np.empty((len(x), len(targets)))
            for f in np.unique(at):
                own = at == f
                w, c = zip(*[models[int(f), t] for t in targets])
                pred[own] = x[own] @ np.column_stack(w) + np.array(c)
            yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(list(pred), pa.list_(pa.float64()))], schema=kind)

    given = rows.where(F.col(fold_col).isin(list(folds))).select(
        "_x", F.col(fold_col).cast("int").alias("_f"), key, fold_col, *[F.col(t).cast("double").alias(t) for t in targets])
    schema = T.StructType([*given.schema.fields[2:], T.StructField("_p", T.ArrayType(T.DoubleType()))])
    kind = to_arrow_schema(schema)
    per = [F.struct(F.lit(t).alias("target"), F.col(t).alias("y"), F.col("_p")[i].alias("pred")) for i, t in enumerate(targets)]
    return given.mapInArrow(run, schema).select(key, fold_col, F.inline(F.array(*per)))


def fit_fold_models(df: DataFrame, targets, tokens_col: str, numeric_cols, k: int = 5, fold_col: str = "kfold",
                    reg: float = 0.1):
    """The models trained on the other folds, {(fold, target): (weights, intercept)}, with the columns they read."""
    rows = _text_rows(df, [fold_col, *targets], tokens_col, numeric_cols)
    models = _fit(rows, targets, fold_col, NUM_FEATURES + len(numeric_cols), range(k), reg)
    return {"tokens": tokens_col, "numeric": list(numeric_cols), "models": models}


def fold_inference(fitted: dict, test: DataFrame, key: str) -> DataFrame:
    """Every fold model scores the test rows in one pass; predictions averaged per key and target."""
    names, width = list(fitted["models"]), NUM_FEATURES + len(fitted["numeric"])
    weights = np.column_stack([fitted["models"][n][0] for n in names])
    intercepts = np.array([fitted["models"][n][1] for n in names])
    given = _text_rows(test, [key], fitted["tokens"], fitted["numeric"]).select("_x", key)
    schema = T.StructType([given.schema[key], T.StructField("_p", T.ArrayType(T.DoubleType()))])
    kind = to_arrow_schema(schema)

    def run(batches):
        for part, x in _blocks(batches, width):
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(list(x @ weights + intercepts), pa.list_(pa.float64()))], schema=kind)

    per = [F.struct(F.lit(t).alias("target"), F.lit(f).alias("model_fold"), F.col("_p")[i].alias("pred")) for i, (f, t) in enumerate(names)]
    return given.mapInArrow(run, schema).select(key, F.inline(F.array(*per))).groupBy(key, "target").agg(F.avg("pred").alias("pred"))


CLASSIFIERS = {
    "random_forest": lambda: RandomForestClassifier(numTrees=30, maxDepth=5, seed=42),
    "gbt": lambda: GBTClassifier(maxIter=20, maxDepth=3, seed=42),
    "logistic": lambda: LogisticRegression(maxIter=20, regParam=0.01),
    "linear_svc": lambda: LinearSVC(maxIter=20, regParam=0.01),
    "naive_bayes": lambda: NaiveBayes(modelType="gaussian"),
}


def classifier_bakeoff(train: DataFrame, valid: DataFrame, feature_cols, label_col: str) -> DataFrame:
    """Accuracy of each classifier family on a holdout (features standardized)."""
    spark = train.sparkSession
    train, valid = materialize(train), materialize(valid)
    rows = []
    asm = VectorAssembler(inputCols=list(feature_cols), outputCol="_raw", handleInvalid="keep")
    sc = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)
    for name, make in CLASSIFIERS.items():
        clf = make().setFeaturesCol("features").setLabelCol(label_col).setPredictionCol("pred")
        m = Pipeline(stages=[asm, sc, clf]).fit(train)
        acc = m.transform(valid).agg(F.avg((F.col("pred") == F.col(label_col)).cast("double")).alias("a")).first()["a"]
        rows.append((name, float(acc) if acc is not None else None))
    return spark.createDataFrame(rows, "model string, accuracy double")


#: stands for a null id or label in numpy code; sorts first, as nulls do
NONE = -(1 << 63)


def _nearest(x: np.ndarray, y: np.ndarray, rank: np.ndarray, k: int, max_dist: float):
    """(row of x, row of y, distance) of the ``k`` nearest rows of ``y`` to each row of ``x``, ties by ``rank``.

    A matrix product finds all that can be among them; their distances come from the differences."""
    square, out = (y ** 2).sum(axis=1), []
    step = max(1, (1 << 22) // len(y))
    for first in range(0, len(x), step):
        part = x[first:first + step]
        own = (part ** 2).sum(axis=1)
        near = own[:, None] + square[None] - 2 * (part @ y.T)
        last = np.partition(near, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
        # far above the product's rounding error
        most = last + 1e-9 * (own + square.max())
        for i in range(len(part)):
            at = np.flatnonzero(near[i] <= most[i])
            dist = np.sqrt(((y[at] - part[i]) ** 2).sum(axis=1))
            best = np.lexsort((rank[at], dist))[:k]
            best = best[dist[best] < max_dist]
            out.append((np.full(len(best), first + i), at[best], dist[best]))
    return [np.concatenate(c) for c in zip(*out)]


def knn_vote(queries: DataFrame, refs: DataFrame, key: str, vec_col: str, label_col: str, k: int = 3,
             bucket_length: float = 4.0, num_tables: int = 3, max_dist: float = 1e9, block: int = 8192) -> DataFrame:
    """k nearest reference vectors by Euclidean distance and a majority vote (ties:
    lowest label).  Candidates come from random-projection LSH buckets: all pairs that share
    the bucket of one table at least.

    Rows with the same buckets in all tables are dealt to blocks of about ``block`` rows; two blocks meet
    if they share a bucket, and only the k nearest of a query leave the meeting, so wide buckets
    cost products of matrices and no row a pair.  Rows without a vector are left out."""
    def hashed(df, model, names):
        buckets = F.concat(*[vector_to_array(F.col("_h")[i]) for i in range(num_tables)])
        df = model.transform(df.withColumn("v", array_to_vector("vec"))).select(*names, "vec", buckets.cast("array<long>").alias("sig"))
        parts = df.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / block).alias("_n"))
        df = df.join(parts, "sig").withColumn("part", F.pmod(F.xxhash64(*names, "vec"), F.col("_n"))).drop("_n")
        return materialize(df, "vote-blocks")

    def clean(df, *cols):  # a row given several times is one
        vec = F.col(vec_col).cast("array<double>")
        return df.where(vec.isNotNull()).select(*cols, vec.alias("vec")).distinct()

    def or_none(c):
        return F.coalesce(F.col(c).cast("long"), F.lit(NONE))
    q = clean(queries, or_none(key).alias("qid"))
    r = clean(refs, or_none(key).alias("rid"), or_none(label_col).alias("rlabel"))
    lsh = BucketedRandomProjectionLSH(inputCol="v", outputCol="_h", bucketLength=bucket_length,
                                      numHashTables=num_tables, seed=42).fit(r.select(array_to_vector("vec").alias("v")))
    q, r = hashed(q, lsh, ["qid"]), hashed(r, lsh, ["rid", "rlabel"])

    def buckets(df, side):
        blocks = df.select("sig", "part").distinct()
        return blocks.select(F.col("sig").alias(f"{side}_sig"), F.col("part").alias(f"{side}_part"),
                             F.posexplode("sig").alias("table", "bucket"))
    meet = materialize(buckets(q, "q").join(buckets(r, "r"), ["table", "bucket"]).drop("table", "bucket").distinct(), "vote-meetings")

    def sent(df, side):
        return df.withColumnsRenamed({"sig": f"{side}_sig", "part": f"{side}_part"}).join(meet, [f"{side}_sig", f"{side}_part"])

    def run(a, b):
        if not len(a) or not len(b):
            return pd.DataFrame({"qid": [], "rid": [], "rlabel": [], "dist": []})
        x, y = (np.stack(c.to_numpy()).astype(np.float64) for c in (a["vec"], b["vec"]))
        i, j, dist = _nearest(x, y, b["rid"].to_numpy(), k, max_dist)
        return pd.DataFrame({"qid": a["qid"].to_numpy()[i], "rid": b["rid"].to_numpy()[j],
                             "rlabel": b["rlabel"].to_numpy()[j], "dist": dist})
    by = ["q_sig", "q_part", "r_sig", "r_part"]
    found = sent(q, "q").groupBy(*by).cogroup(sent(r, "r").groupBy(*by)).applyInPandas(
        run, "qid long, rid long, rlabel long, dist double")
    w = Window.partitionBy("qid").orderBy("dist", "rid")
    near = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    near = near.withColumn("rlabel", F.nullif("rlabel", F.lit(NONE)).cast(refs.schema[label_col].dataType))
    votes = near.groupBy("qid", "rlabel").agg(F.count(F.lit(1)).alias("_v"))
    return votes.groupBy(F.nullif("qid", F.lit(NONE)).cast(queries.schema[key].dataType).alias(key)) \
        .agg(F.min_by("rlabel", F.struct(-F.col("_v"), F.col("rlabel"))).alias("pred"))


def feature_importance(df: DataFrame, feature_cols, label_col: str) -> DataFrame:
    """Decision-tree importances of every feature, descending."""
    asm = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="keep")
    m = Pipeline(stages=[asm, DecisionTreeClassifier(labelCol=label_col, maxDepth=5, seed=42)]).fit(df)
    imp = m.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(feature_cols, imp), key=lambda x: (-x[1], x[0]))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def _cv_accuracy(df, feature_cols, label_col, fold_col, k, make):
    accs = []
    for f in range(k):
        tr, va = df.where(F.col(fold_col) != f), df.where(F.col(fold_col) == f)
        asm = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="keep")
        m = Pipeline(stages=[asm, make().setLabelCol(label_col).setPredictionCol("pred")]).fit(tr)
        a = m.transform(va).agg(F.avg((F.col("pred") == F.col(label_col)).cast("double"))).first()[0]
        accs.append(a if a is not None else 0.0)
    return sum(accs) / len(accs)


def rfe_cv(df: DataFrame, feature_cols, label_col: str, fold_col: str = "kfold", k: int = 3,
           min_features: int = 1) -> DataFrame:
    """Recursive feature elimination: fit, drop the least important feature, CV-score;
    one row per step (a driver loop bounded by the feature count)."""
    feats = list(feature_cols)
    df = materialize(df.select(label_col, fold_col, *feats))
    rows = []
    while len(feats) >= min_features:
        acc = _cv_accuracy(df, feats, label_col, fold_col, k, lambda: DecisionTreeClassifier(maxDepth=5, seed=42))
        imp = feature_importance(df, feats, label_col).orderBy("importance", "feature").first()
        rows.append((len(feats), ",".join(feats), float(acc), imp["feature"]))
        if len(feats) == min_features:
            break
        feats.remove(imp["feature"])
    return df.sparkSession.createDataFrame(rows, "n_features int, features string, cv_accuracy double, weakest string")


def config_search(df: DataFrame, feature_cols, label_col: str, space: dict, fold_col: str = "kfold", k: int = 3,
                  n_random: int = 3, seed: int = 42) -> DataFrame:
    """Coordinate-greedy search over a grid (best value per axis carried forward),
    then ``n_random`` random single-axis changes; every trial is a Spark CV job."""
    rng = random.Random(seed)
    df = materialize(df.select(label_col, fold_col, *feature_cols))
    axes = list(space)
    best = {a: space[a][0] for a in axes}
    trials = []

    def score(cfg):
        return _cv_accuracy(df, feature_cols, label_col, fold_col, k,
                            lambda: LogisticRegression(maxIter=20, **cfg))
    best_score = score(best)
    trials.append(("init", dict(best), best_score))
    for a in axes:
        for v in space[a][1:]:
            cfg = dict(best, **{a: v})
            s = score(cfg)
            trials.append((f"greedy:{a}", cfg, s))
            if s > best_score:
                best, best_score = cfg, s
    for _ in range(n_random):
        a = rng.choice(axes)
        cfg = dict(best, **{a: rng.choice(space[a])})
        s = score(cfg)
        trials.append((f"random:{a}", cfg, s))
        if s > best_score:
            best, best_score = cfg, s
    rows = [(i, kind, str(sorted(c.items())), float(s)) for i, (kind, c, s) in enumerate(trials)]
    return df.sparkSession.createDataFrame(rows, "trial int, kind string, config string, cv_accuracy double")


class Gene:
    """One place of a genome: a real number or an integer between two bounds."""

    def __init__(self, low: float, high: float, integer: bool = False):
        self.low, self.high, self.integer = low, high, integer

    def between(self, rng, low: float, high: float):
        """Any value from ``low`` to ``high``."""
        return rng.randint(int(low), int(high)) if self.integer else low + rng.random() * (high - low)

    def any(self, rng):
        return self.between(rng, self.low, self.high)


def cross(rng, a: list, b: list, kind: str) -> tuple[list, list]:
    """Two children: ``one_point`` and ``two_point`` exchange a stretch, ``uniform`` single places."""
    n = len(a)
    if kind == "uniform":
        swap = [rng.random() < 0.5 for _ in range(n)]
    elif kind == "one_point":
        cut = rng.randrange(n + 1)
        swap = [i < cut for i in range(n)]
    elif kind == "two_point":
        low, high = sorted((rng.randrange(n + 1), rng.randrange(n + 1)))
        swap = [low <= i < high for i in range(n)]
    else:
        raise ValueError(f"unknown crossover {kind}")
    return [y if s else x for x, y, s in zip(a, b, swap)], [x if s else y for x, y, s in zip(a, b, swap)]


def evolve(score_fn, genes: list[Gene], population: int = 20, generations: int = 50, mutation: float = 0.1,
           elite_frac: float = 0.05, parents_frac: float = 0.3, crossover_chance: float = 0.5, crossover: str = "uniform",
           patience: int | None = None, repair=None, seed: int = 42) -> list[tuple[int, int, list, float]]:
    """Evolutionary search that minimizes ``score_fn(genomes) -> {index: score}``: every genome
    scored, as (generation, index, genome, score).

    A generation is one call, so one Spark job over all rows; the driver holds the population
    alone.  Parents are the elite and a draw by ``max - score + 1``; they stay in the next
    population, and children of two of them (each parent is picked for crossing with
    ``crossover_chance``) fill it.  The first child's places mutate to any value, the
    second's to one between its parents' (any value where these agree).  Integers stay
    integers and all places in their bounds; ``repair`` may map a genome to a valid one.
    Stops after ``patience`` generations without gain."""
    rng, fix = random.Random(seed), repair or (lambda g: g)
    pop = [fix([g.any(rng) for g in genes]) for _ in range(population)]
    history, best, still = [], None, 0
    for turn in range(generations):
        scores = score_fn(pop)
        ranked = sorted(range(len(pop)), key=lambda i: (scores[i], i))
        history += [(turn, i, pop[i], scores[i]) for i in range(len(pop))]
        still = 0 if best is None or scores[ranked[0]] < best else still + 1
        best = scores[ranked[0]] if still == 0 else best
        if patience is not None and still >= patience:
            break
        n_parents = max(2, int(parents_frac * population))
        parents = [pop[i] for i in ranked[:max(1, min(n_parents, int(elite_frac * population)))]]
        worst = max(scores[i] for i in ranked)
        fit = [worst - scores[i] + 1 for i in range(len(pop))]
        parents += [pop[i] for i in rng.choices(range(len(pop)), weights=fit, k=n_parents - len(parents))]
        able = [p for p in parents if rng.random() < crossover_chance]
        able = able if len(able) >= 2 else parents[:2]
        following = list(parents)
        while len(following) < population:
            a, b = rng.sample(able, 2)
            one, two = cross(rng, a, b, crossover)
            one = [g.any(rng) if rng.random() < mutation else x for g, x in zip(genes, one)]
            two = [(g.between(rng, min(x, y), max(x, y)) if x != y else g.any(rng)) if rng.random() < mutation else z
                   for g, x, y, z in zip(genes, a, b, two)]
            following += [fix(one), fix(two)]
        pop = following[:population]
    return history


def evolve_weights(score_fn, n_weights: int, population: int = 20, generations: int = 5, mutation: float = 0.1,
                   elite_frac: float = 0.01, crossover: float = 0.5, parents_frac: float = 0.3, seed: int = 42):
    """Elitist evolutionary search minimizing ``score_fn(candidates) -> {cand_id: score}``.

    The driver holds only the population (<= ``population`` weight vectors); each
    generation's fitness is one Spark job over the full OOF table.  Selection is
    roulette on ``max - obj + 1``; uniform crossover; the second child mutates
    between its parents.  Weights are renormalized to sum to one.
    """
    rng = random.Random(seed)

    def norm(w):
        w = [max(0.0, x) for x in w]
        s = sum(w) or 1.0
        return [x / s for x in w]
    pop = [norm([rng.random() for _ in range(n_weights)]) for _ in range(population)]
    history = []
    for g in range(generations):
        scores = score_fn(pop)
        ranked = sorted(range(len(pop)), key=lambda i: (scores[i], i))
        history += [(g, i, pop[i], scores[i]) for i in range(len(pop))]
        n_elite = max(1, int(elite_frac * population))
        n_par = max(2, int(parents_frac * population))
        objs = [scores[i] for i in range(len(pop))]
        mx, mn = max(objs), min(objs)
        shift = -mn if mn < 0 else 0.0
        fit = [(mx + shift) - (o + shift) + 1 for o in objs]
        tot = sum(fit)
        parents = [pop[i] for i in ranked[:n_elite]]
        while len(parents) < n_par:
            r, acc = rng.random() * tot, 0.0
            for i, fv in enumerate(fit):
                acc += fv
                if acc >= r:
                    parents.append(pop[i])
                    break
        nxt = [pop[i] for i in ranked[:n_elite]]
        while len(nxt) < population:
            a, b = rng.sample(parents, 2)
            c1 = [x if rng.random() < crossover else y for x, y in zip(a, b)]
            c2 = [min(x, y) + rng.random() * abs(x - y) if rng.random() < mutation else z
                  for x, y, z in zip(a, b, c1)]
            c1 = [rng.random() if rng.random() < mutation else x for x in c1]
            nxt += [norm(c1), norm(c2)]
        pop = nxt[:population]
    return history


def sampled_trials(space: dict, n: int, seed: int = 42) -> list[dict]:
    """``n`` configurations drawn by keyed hashes, so that trial i is the same in every order and
    number of trials.  An axis is a list (one of it), ``("range", low, high)`` or ``("log", low, high)``."""
    out = []
    for i in range(n):
        trial = {}
        for axis, values in sorted(space.items()):
            u = int(hashlib.md5(f"{seed}|{i}|{axis}".encode()).hexdigest()[:13], 16) / 16 ** 13
            if isinstance(values, tuple):
                kind, low, high = values
                trial[axis] = low + u * (high - low) if kind == "range" else low * (high / low) ** u
            else:
                trial[axis] = values[int(u * len(values))]
        out.append(trial)
    return out


def halving_search(score_fn, trials: list[dict], k: int, keep: float = 0.5) -> list[tuple[int, int, float]]:
    """Successive halving by fold: every trial is scored on fold 0, the better ``keep`` of them on
    fold 1 too, and so on.  ``score_fn(trials, fold) -> [score]`` (higher is better).  Returns
    (trial, folds scored, mean score), the best first: more folds, then the mean, then the number."""
    alive, scores = list(range(len(trials))), {i: [] for i in range(len(trials))}
    mean = lambda i: sum(scores[i]) / len(scores[i])
    for fold in range(k):
        for i, x in zip(alive, score_fn([trials[i] for i in alive], fold)):
            scores[i].append(x)
        if fold < k - 1:
            alive = sorted(sorted(alive, key=lambda i: (-mean(i), i))[:max(1, -(-int(len(alive) * keep * 1000) // 1000))])
    return sorted(((i, len(s), mean(i)) for i, s in scores.items() if s), key=lambda r: (-r[1], -r[2], r[0]))


def trial_search(df: DataFrame, feature_cols, label_col: str, space: dict, n_trials: int = 8, fold_col: str = "kfold",
                 k: int = 3, seed: int = 42) -> DataFrame:
    """Sampled trials of a logistic regression with successive halving: (trial, config, folds, accuracy).
    A round prepares its fold's rows once and fits every remaining trial on them."""
    cols = list(feature_cols)
    asm = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")
    d = materialize(asm.transform(df).select(F.col(label_col).alias("label"), fold_col, "features"), "trials")
    trials = sampled_trials(space, n_trials, seed)

    def score(some, fold):
        train, valid = d.where(F.col(fold_col) != fold), d.where(F.col(fold_col) == fold)
        out = []
        for cfg in some:
            model = LogisticRegression(maxIter=20, predictionCol="pred", **cfg).fit(train)
            acc = model.transform(valid).agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
            out.append(acc if acc is not None else 0.0)
        return out
    rows = [(i, ", ".join(f"{a}={v:.6g}" for a, v in sorted(trials[i].items())), n, float(x)) for i, n, x in halving_search(score, trials, k)]
    return df.sparkSession.createDataFrame(rows, "trial int, config string, folds int, accuracy double")
