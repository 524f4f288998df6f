"""Modelling plans (rows-only checks: fitted models have no SQL equivalent)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.hashing import uniform
from tessera.operators import ml as ML
from tessera.operators.ensemble import score_candidates
from tessera.operators.features import one_hot
from tessera.operators.metrics import rmse_per_target
from tessera.operators.neighbors import knn, vote
from tessera.operators.splits import group_fold_table, holdout_split, random_kfold
from tessera.plans import sql as S
from tessera.plans.common import ESSAY_TARGETS, essay_frame
from tessera.plans.registry import query
from tessera.session import materialize
from tessera.sources.tables import Tables

NUMERIC = ["n_lines"]
CLS_NUMERIC = ["n_chars", "t_ari", "t_wlen", "t_loglen"]


def essay_ml(t, k: int = 5):
    e = essay_frame(t).join(t.documents.select("doc_id", F.size(F.split("text", "\n", -1)).cast("double")
                                               .alias("n_lines")), "doc_id")
    e = e.withColumn("tokens", F.array_remove(F.split("clean", " ", -1), "")).drop("clean")
    return _small_folds(e, t.documents, k)


def _small_folds(df, groups, k: int):
    """``group_kfold`` by source.  The fold table is written first: known to be small before the join, it
    is sent to the rows, and texts are not dealt by source."""
    folds = group_fold_table(groups.select("source"), "source", k=k, seed=42)
    return df.join(materialize(folds, "source-folds"), "source", "left")


def cls_frame(t):
    e = essay_frame(t).join(t.documents.select("doc_id", F.col("n_chars").cast("double").alias("n_chars")), "doc_id")
    e = one_hot(e, "lang", prefix="lang")
    d = e.join(t.labels.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    return random_kfold(d, "doc_id", k=3, seed=42)


def _features(d):
    """The numeric features and a flag for every language of the data."""
    return [*CLS_NUMERIC, *sorted(c for c in d.columns if c.startswith("lang_"))]


def _oof(spark, sf):
    return ML.cv_regression(essay_ml(Tables(spark, sf)), "doc_id", ESSAY_TARGETS, "tokens", NUMERIC, k=5)


@query("cv_regression_text")
def q_cv_regression_text(spark, sf):
    """One linear regressor per fold and target on hashed TF-IDF + numeric features."""
    return _oof(spark, sf).withColumn("pred", F.round("pred", 6))


@query("oof_score_text")
def q_oof_score_text(spark, sf):
    per = materialize(rmse_per_target(_oof(spark, sf)), "oof-rmse")  # read twice, a row a target
    tot = per.agg(F.lit("MCRMSE").alias("target"), F.avg("rmse").alias("rmse"), F.sum("n").alias("n"))
    return per.unionByName(tot).withColumn("rmse", F.round("rmse", 6))


@query("test_inference_text")
def q_test_inference_text(spark, sf):
    """Fold models trained on the train share score the held-out rows; fold-averaged."""
    t = Tables(spark, sf)
    e = materialize(holdout_split(essay_ml(t, k=3).drop("kfold"), "doc_id", frac=0.7, seed=7), "holdout")
    train = e.where("is_train")
    train = _small_folds(train, train, k=3)
    test = e.where(~F.col("is_train"))
    models = ML.fit_fold_models(train, ESSAY_TARGETS, "tokens", NUMERIC, k=3)
    return ML.fold_inference(models, test, "doc_id").withColumn("pred", F.round("pred", 6))


@query("classifier_bakeoff")
def q_classifier_bakeoff(spark, sf):
    d = holdout_split(cls_frame(Tables(spark, sf)), "doc_id", frac=0.7, seed=3)
    return ML.classifier_bakeoff(d.where("is_train"), d.where(~F.col("is_train")), _features(d), "label")


@query("knn_vote")
def q_knn_vote(spark, sf):
    """3-NN label vote for a hashed 30 % of the vectors against the rest (LSH candidates)."""
    e = Tables(spark, sf).embeddings.withColumn("_u", uniform(21, "vec_id"))
    q, r = e.where(F.col("_u") < 0.3), e.where(F.col("_u") >= 0.3)
    v = ML.knn_vote(q, r, "vec_id", "embedding", "label", k=3)
    return v.join(q.select("vec_id", "label"), "vec_id")


@query("feature_importance")
def q_feature_importance(spark, sf):
    d = materialize(cls_frame(Tables(spark, sf)), "classes")
    return ML.feature_importance(d, _features(d), "label")


@query("rfe_cv")
def q_rfe_cv(spark, sf):
    d = cls_frame(Tables(spark, sf))
    return ML.rfe_cv(d, _features(d), "label", k=3, min_features=4)


@query("config_search")
def q_config_search(spark, sf):
    space = {"regParam": [0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5]}
    d = cls_frame(Tables(spark, sf))
    return ML.config_search(d, _features(d), "label", space, k=3, n_random=2)


@query("evolve_weights")
def q_evolve_weights(spark, sf):
    """Evolutionary search of run weights; every generation is one Spark scoring job."""
    from tessera.plans.q_ensemble import _wide
    wide = materialize(_wide(Tables(spark, sf)))

    def score_fn(pop):
        sc = score_candidates(wide, pop, ["p0", "p1", "p2"], clip_cols=("lo", "hi")).collect()
        return {r["cand_id"]: r["score"] for r in sc}
    hist = ML.evolve_weights(score_fn, 3, population=20, generations=4)
    rows = [(g, i, float(w[0]), float(w[1]), float(w[2]), float(s)) for g, i, w, s in hist]
    return spark.createDataFrame(rows, "generation int, cand int, w0 double, w1 double, w2 double, score double")


@query("knn_exact", f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label, {S.u(21, 'vec_id')} AS u FROM embeddings),
p AS (SELECT q.vec_id, q.label, r.vec_id AS rid, r.label AS rlabel, list_distance(q.v, r.v) AS dist
      FROM e q, e r WHERE q.u < 0.3 AND r.u >= 0.3),
n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, rid) AS nth FROM p QUALIFY nth <= 3),
v AS (SELECT vec_id, rlabel, count(*) AS c FROM n GROUP BY ALL),
w AS (SELECT vec_id, rlabel AS pred FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, rlabel) = 1)
SELECT n.vec_id, any_value(label) AS label, any_value(w.pred) AS pred,
       string_agg(CAST(rid AS VARCHAR), ' ' ORDER BY nth) AS nearest, round(max(dist), 6) AS farthest
FROM n JOIN w USING (vec_id) GROUP BY n.vec_id""")
def q_knn_exact(spark, sf):
    """Exact 3-NN of the same 30 % of the vectors, with the vote of the labels."""
    e = Tables(spark, sf).embeddings.withColumn("_u", uniform(21, "vec_id"))
    q, r = e.where(F.col("_u") < 0.3), e.where(F.col("_u") >= 0.3)
    near, _ = knn(q, r, "vec_id", "embedding", "label", k=3)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("nth", "rid"))), lambda x: x["rid"].cast("string"))
    rows = near.groupBy("id").agg(F.array_join(ids, " ").alias("nearest"), F.round(F.max("dist"), 6).alias("farthest"))
    return (rows.join(vote(near), "id").join(q.select(F.col("vec_id").alias("id"), "label"), "id")
            .select(F.col("id").alias("vec_id"), "label", "pred", "nearest", "farthest"))


@query("trial_search")
def q_trial_search(spark, sf):
    """Trials over a log range and a range, halved fold by fold."""
    d = cls_frame(Tables(spark, sf))
    space = {"regParam": ("log", 1e-4, 1.0), "elasticNetParam": ("range", 0.0, 1.0)}
    return ML.trial_search(d, _features(d), "label", space, n_trials=6, k=3)


@query("evolve_mixed")
def q_evolve_mixed(spark, sf):
    """Weights of the runs and a rounding step (an integer) evolve together: real and integer places."""
    from tessera.plans.q_ensemble import _wide
    wide = _wide(Tables(spark, sf))

    def score_fn(pop):
        # the step rounds predictions to its tenths: one aggregate for the whole population
        def loss(g):
            p = sum((F.lit(float(w)) * F.col(c) for w, c in zip(g, ("p0", "p1", "p2"))), F.lit(0.0))
            p = F.least(F.greatest(F.round(p * 10 / g[3]) * g[3] / 10, F.col("lo")), F.col("hi"))
            return F.avg(F.pow(p - F.col("y"), 2))
        per = wide.groupBy("target").agg(*[loss(g).alias(f"s{i}") for i, g in enumerate(pop)]).collect()
        return {i: sum(r[f"s{i}"] ** 0.5 for r in per) / len(per) for i in range(len(pop))}

    def unit(g):
        total = sum(g[:3]) or 1.0
        return [x / total for x in g[:3]] + [g[3]]
    genes = [ML.Gene(0, 1)] * 3 + [ML.Gene(1, 9, integer=True)]
    hist = ML.evolve(score_fn, genes, population=16, generations=6, patience=3, crossover="two_point", repair=unit)
    return spark.createDataFrame([(t, i, *map(float, g[:3]), int(g[3]), float(s)) for t, i, g, s in hist],
                                 "generation int, cand int, w0 double, w1 double, w2 double, step int, score double")
