"""Fold models, OOF tables, ensembles, weight search and scoring plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import ensemble as EN
from tessera.operators.metrics import (bce_with_logits, classification_report, cross_entropy_binary,
                                       focal_loss_binary, loss_columns)
from tessera.operators.oof import fold_average, oof_select
from tessera.plans import sql as S
from tessera.plans.common import class_probs, oof_runs, run_predictions
from tessera.plans.registry import query
from tessera.session import materialize
from tessera.sources.tables import Tables

RUN_WEIGHTS = [("lang", 0.5), ("source", 0.3), ("all", 0.2)]


def _r6(df, cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("oof_select", f"""
WITH {S.RUN_CTES}
SELECT doc_id, target, kfold, round(pred, 6) AS pred FROM fm_lang WHERE model_fold = kfold""")
def q_oof_select(spark, sf):
    p = run_predictions(Tables(spark, sf)).where(F.col("run") == "lang")
    return _r6(oof_select(p).select("doc_id", "target", "kfold", "pred"), ["pred"])


@query("fold_average", f"""
WITH {S.RUN_CTES}
SELECT doc_id, target, round(avg(pred), 6) AS pred, count(*) AS n_models FROM fm_lang GROUP BY doc_id, target""")
def q_fold_average(spark, sf):
    p = run_predictions(Tables(spark, sf)).where(F.col("run") == "lang")
    return _r6(fold_average(p, ["doc_id", "target"]), ["pred"])


_W_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{r}', {w})" for r, w in RUN_WEIGHTS) + ") v(run, weight))"


@query("ensemble_weighted", f"""
WITH {S.RUN_CTES},
rng AS (SELECT target, min(y) AS lo, max(y) AS hi FROM long GROUP BY target),
e AS (SELECT doc_id, target, sum(weight * pred) / sum(weight) AS p FROM oof_runs JOIN {_W_SQL} w USING (run) GROUP BY doc_id, target)
SELECT doc_id, target, round(greatest(least(p, hi), lo), 6) AS pred FROM e JOIN rng USING (target)""")
def q_ensemble_weighted(spark, sf):
    """Weighted mean of the runs' OOF predictions, clipped to the target's range."""
    o = oof_runs(Tables(spark, sf))
    w = spark.createDataFrame(RUN_WEIGHTS, "run string, weight double")
    e = EN.weighted_ensemble(o, w, ["doc_id", "target"], out="p")
    rng = o.where(F.col("run") == "lang").groupBy("target").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    return e.join(rng, "target").select("doc_id", "target", F.round(EN.clip(F.col("p"), F.col("lo"), F.col("hi")), 6)
                                        .alias("pred"))


CANDS = EN.simplex_grid(3, 0.1)
_C_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {a!r}, {b!r}, {c!r})" for i, (a, b, c) in enumerate(CANDS)) + ") v(cand_id, w0, w1, w2))"
_GRID_CTES = f"""
{S.RUN_CTES},
rng AS (SELECT target, min(y) AS lo, max(y) AS hi FROM long GROUP BY target),
wide AS (SELECT doc_id, target, any_value(y) AS y,
                max(pred) FILTER (WHERE run = 'lang') AS p0, max(pred) FILTER (WHERE run = 'source') AS p1,
                max(pred) FILTER (WHERE run = 'all') AS p2 FROM oof_runs GROUP BY doc_id, target),
per AS (SELECT cand_id, target,
               sqrt(avg(power(greatest(least(w0 * p0 + w1 * p1 + w2 * p2, hi), lo) - y, 2))) AS rmse
        FROM wide JOIN rng USING (target), {_C_SQL} c GROUP BY cand_id, target),
sc AS (SELECT cand_id, avg(rmse) AS score FROM per GROUP BY cand_id)
"""


def _wide(t):
    """(doc_id, target, y, p0, p1, p2, lo, hi), written once: every search reads it again."""
    o = oof_runs(t)
    wide = materialize(o.groupBy("doc_id", "target").agg(
        F.any_value("y").alias("y"), *[F.max(F.when(F.col("run") == r, F.col("pred"))).alias(f"p{i}")
                                       for i, r in enumerate(("lang", "source", "all"))]), "oof_wide")
    rng = wide.groupBy("target").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    return materialize(wide.join(rng, "target"), "oof_wide_range")


def _grid_scores(spark, t):
    cands = spark.createDataFrame([(i, *w) for i, w in enumerate(CANDS)], "cand_id int, w0 double, w1 double, w2 double")
    sc = materialize(EN.score_candidates(_wide(t), CANDS, ["p0", "p1", "p2"], clip_cols=("lo", "hi")), "grid_scores")
    return F.broadcast(cands).join(sc, "cand_id")


@query("weight_descent", f"""
WITH {_GRID_CTES}
SELECT runs, (SELECT round(min(score), 6) FROM sc) AS grid_score, TRUE AS no_worse, TRUE AS on_simplex
FROM (VALUES (3), (10)) v(runs)""")
def q_weight_descent(spark, sf):
    """Weights of three and of ten runs by descent: no worse than the best of the three-run grid, which is
    checked.  The other seven runs are distorted mixtures of the three."""
    wide = _wide(Tables(spark, sf))
    more = {"p3": "p0 * 1.1", "p4": "p1 * 0.9", "p5": "p2 + 0.2", "p6": "(p0 + p1) / 2 - 0.1", "p7": "(p1 + p2) / 2 * 1.05",
            "p8": "p0 * 2 - p2", "p9": "p1 * 1.5 - p0 * 0.5"}
    ten = wide.selectExpr("*", *[f"{x} AS {c}" for c, x in more.items()])
    grid = EN.score_candidates(wide, CANDS, ["p0", "p1", "p2"], clip_cols=("lo", "hi")).agg(F.min("score")).first()[0]
    rows = []
    for n in (3, 10):
        w, score = EN.descend_weights(ten, [f"p{i}" for i in range(n)], clip_cols=("lo", "hi"))
        rows.append((n, round(grid, 6), score <= grid + 1e-6, min(w) >= 0 and abs(sum(w) - 1) < 1e-9))
    return spark.createDataFrame(rows, "runs int, grid_score double, no_worse boolean, on_simplex boolean")


@query("weight_grid", f"""
WITH {_GRID_CTES}
SELECT c.cand_id, c.w0, c.w1, c.w2, round(score, 6) AS score,
       c.cand_id = (SELECT arg_min(cand_id, (round(score, 9), cand_id)) FROM sc) AS is_best
FROM sc JOIN {_C_SQL} c USING (cand_id)""")
def q_weight_grid(spark, sf):
    """Exact clipped MCRMSE of every simplex-grid weight vector over the OOF table."""
    g = _grid_scores(spark, Tables(spark, sf))
    # ties (to 1e-9) go to the lowest candidate id, whatever the summation order
    best = g.agg(F.min_by("cand_id", F.struct(F.round("score", 9), F.col("cand_id"))).alias("_best"))
    return (g.crossJoin(F.broadcast(best)).withColumn("is_best", F.col("cand_id") == F.col("_best"))
            .select("cand_id", "w0", "w1", "w2", F.round("score", 6).alias("score"), "is_best"))


@query("roulette_cumshare", f"""
WITH {_GRID_CTES},
st AS (SELECT min(score) AS mn, max(score) AS mx FROM sc),
f AS (SELECT cand_id, score, (mx + CASE WHEN mn < 0 THEN -mn ELSE 0 END) - (score + CASE WHEN mn < 0 THEN -mn ELSE 0 END) + 1 AS fitness
      FROM sc, st)
SELECT cand_id, round(score, 6) AS score, round(fitness, 6) AS fitness,
       round(sum(fitness) OVER (ORDER BY cand_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(fitness) OVER (), 6) AS cum_share
FROM f""")
def q_roulette_cumshare(spark, sf):
    g = _grid_scores(spark, Tables(spark, sf)).select("cand_id", "score")
    return _r6(EN.roulette_cumshare(g), ["score", "fitness", "cum_share"])


@query("vote_ensemble", f"""
WITH {S.CLS_CTES}
SELECT doc_id, round(score, 6) AS score, CAST(score >= 0.5 AS INTEGER) AS pred FROM votes""")
def q_vote_ensemble(spark, sf):
    """Hard 0/1 votes of 15 models, fixed weights (0.2 for the first five, 0.07 after)."""
    p = class_probs(Tables(spark, sf))
    runs = [f"{r}_{m}" for r in ("lang", "source", "all") for m in range(5)]
    w = spark.createDataFrame(EN.vote_weights(runs), "run string, weight double")
    v = EN.vote_ensemble(p.withColumn("cls", (F.col("p") >= 0.5).cast("int")), w, ["doc_id"])
    return v.select("doc_id", F.round("score", 6).alias("score"), "pred")


@query("fold_vote", f"""
WITH {S.CLS_CTES}
SELECT doc_id, round_even(avg(round_even(p, 0)), 0) AS vote FROM probs WHERE grp = 0 GROUP BY doc_id""")
def q_fold_vote(spark, sf):
    p = class_probs(Tables(spark, sf)).where(F.col("grp") == 0)
    return EN.fold_vote(p, ["doc_id"], "p")


_CLASS_CTES = f"""
{S.LONG_CTES},
cls AS (SELECT e.doc_id, e.source, c.cls AS target, CAST(e.lang = c.cls AS DOUBLE) AS y, f.kfold
        FROM essay e JOIN folds f USING (source), (SELECT DISTINCT lang AS cls FROM documents WHERE lang IS NOT NULL) c),
{S.fold_models('cls', 'source', name='cls')}
"""


def _class_scores(t):
    """Share of each language of the data in a document's source, by fold model."""
    from tessera.operators.oof import fold_model_predictions
    from tessera.operators.splits import group_kfold
    d = group_kfold(t.documents.select("doc_id", "lang", "source"), "source", k=5, seed=42)
    classes = F.broadcast(d.agg(F.collect_set("lang").alias("classes")))  # one row
    c = (d.crossJoin(classes).select("doc_id", "source", "kfold", "lang", F.explode("classes").alias("target"))
         .withColumn("y", (F.col("lang") == F.col("target")).cast("double")))
    return fold_model_predictions(materialize(c, "class_rows"), "source", 5).select(
        "doc_id", F.col("target").alias("cls"), "model_fold", F.col("pred").alias("score"))


@query("fold_argmax", f"""
WITH {_CLASS_CTES},
a AS (SELECT doc_id, target AS cls, avg(pred) AS s FROM fm_cls GROUP BY doc_id, target)
SELECT doc_id, arg_min(cls, (-s, cls)) AS pred FROM a GROUP BY doc_id""")
def q_fold_argmax(spark, sf):
    """Class shares of the doc's source in the other folds, averaged over fold models, argmax."""
    return EN.fold_argmax(_class_scores(Tables(spark, sf)), ["doc_id"])


@query("model_mean_pivot", f"""
WITH {_CLASS_CTES}
SELECT * FROM (PIVOT fm_cls ON target USING round(avg(pred), 6) GROUP BY doc_id)""")
def q_model_mean_pivot(spark, sf):
    scores = _class_scores(Tables(spark, sf))
    langs = [r["cls"] for r in scores.select("cls").distinct().orderBy("cls").collect()]  # a column each
    return _r6(EN.model_mean_pivot(scores, "doc_id", "cls", "score", langs), langs)


@query("classification_report", f"""
WITH {S.CLS_CTES},
yp AS (SELECT CAST(y AS INTEGER) AS y, CAST(score >= 0.5 AS INTEGER) AS pred FROM votes),
cm AS (SELECT y, pred, count(*) AS c FROM yp GROUP BY y, pred),
cl AS (SELECT y AS cls FROM cm UNION SELECT pred FROM cm),
per AS (SELECT CAST(cls AS VARCHAR) AS class,
               coalesce((SELECT sum(c) FROM cm WHERE cm.y = cl.cls), 0) AS support,
               coalesce((SELECT sum(c) FROM cm WHERE cm.pred = cl.cls), 0) AS predicted,
               coalesce((SELECT sum(c) FROM cm WHERE cm.y = cl.cls AND cm.pred = cl.cls), 0) AS tp FROM cl),
pr AS (SELECT class, support, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
              CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM per),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr),
acc AS (SELECT sum(CASE WHEN y = pred THEN c ELSE 0 END) / sum(c) AS a, sum(c) AS n FROM cm)
SELECT class, CAST(support AS BIGINT) AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f
UNION ALL SELECT 'macro avg', CAST(sum(support) AS BIGINT), round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM f
UNION ALL SELECT 'accuracy', CAST(n AS BIGINT), round(a, 6), round(a, 6), round(a, 6) FROM acc""")
def q_classification_report(spark, sf):
    p = class_probs(Tables(spark, sf))
    runs = [f"{r}_{m}" for r in ("lang", "source", "all") for m in range(5)]
    w = spark.createDataFrame(EN.vote_weights(runs), "run string, weight double")
    v = EN.vote_ensemble(p.withColumn("cls", (F.col("p") >= 0.5).cast("int")), w, ["doc_id", "y"])
    r = classification_report(v.withColumn("y", F.col("y").cast("int")), "y", "pred")
    return _r6(r.withColumn("support", F.col("support").cast("bigint")), ["precision", "recall", "f1"])


@query("loss_metrics", f"""
WITH {S.RUN_CTES},
reg AS (SELECT avg(CASE WHEN abs(pred - y) < 1 THEN 0.5 * (pred - y) * (pred - y) ELSE abs(pred - y) - 0.5 END) AS smooth_l1,
               avg(abs(pred - y)) AS mae FROM oof_runs WHERE run = 'lang' AND pred IS NOT NULL),
{S.CLS_BODY},
pm AS (SELECT doc_id, y, greatest(least(avg(p), 1 - 1e-6), 1e-6) AS p FROM probs WHERE grp = 0 GROUP BY doc_id, y),
lg AS (SELECT y, ln(p / (1 - p)) AS x FROM pm),
cl AS (SELECT avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))) AS bce,
              avg(greatest(0, x) + ln(exp(0 - greatest(0, x)) + exp(x - greatest(0, x))) - CASE WHEN y = 1 THEN x ELSE 0 END) AS ce,
              avg(-(CASE WHEN y = 1 THEN 0.75 ELSE 0.25 END)
                  * power(1 - exp(CASE WHEN y = 1 THEN x ELSE 0 END - (greatest(0, x) + ln(exp(0 - greatest(0, x)) + exp(x - greatest(0, x))))), 2)
                  * (CASE WHEN y = 1 THEN x ELSE 0 END - (greatest(0, x) + ln(exp(0 - greatest(0, x)) + exp(x - greatest(0, x)))))) AS focal_mean,
              sum(-(CASE WHEN y = 1 THEN 0.75 ELSE 0.25 END)
                  * power(1 - exp(CASE WHEN y = 1 THEN x ELSE 0 END - (greatest(0, x) + ln(exp(0 - greatest(0, x)) + exp(x - greatest(0, x))))), 2)
                  * (CASE WHEN y = 1 THEN x ELSE 0 END - (greatest(0, x) + ln(exp(0 - greatest(0, x)) + exp(x - greatest(0, x)))))) AS focal_sum
       FROM lg)
SELECT round(smooth_l1, 6) AS smooth_l1, round(mae, 6) AS mae, round(bce, 6) AS bce, round(ce, 6) AS ce,
       round(focal_mean, 6) AS focal_mean, round(focal_sum, 6) AS focal_sum FROM reg, cl""")
def q_loss_metrics(spark, sf):
    t = Tables(spark, sf)
    o = oof_runs(t).where((F.col("run") == "lang") & F.col("pred").isNotNull())
    lc = loss_columns(F.col("pred"), F.col("y"))
    reg = o.agg(F.avg(lc["smooth_l1"]).alias("smooth_l1"), F.avg(lc["mae"]).alias("mae"))
    p = class_probs(t).where(F.col("grp") == 0).groupBy("doc_id", "y").agg(F.avg("p").alias("p"))
    p = p.withColumn("p", F.greatest(F.least("p", F.lit(1 - 1e-6)), F.lit(1e-6)))
    lg = p.select("y", F.log(F.col("p") / (1 - F.col("p"))).alias("x"))
    x, y, zero = F.col("x"), F.col("y"), F.lit(0.0)
    fl = focal_loss_binary(zero, x, y, 0.25, 0.75, 2.0)
    cl = lg.agg(F.avg(bce_with_logits(x, y)).alias("bce"), F.avg(cross_entropy_binary(zero, x, y)).alias("ce"),
                F.avg(fl).alias("focal_mean"), F.sum(fl).alias("focal_sum"))
    return _r6(reg.crossJoin(cl), ["smooth_l1", "mae", "bce", "ce", "focal_mean", "focal_sum"])


@query("weight_refine")
def q_weight_refine(spark, sf):
    """Coarse simplex grid, then a finer grid around its best point (rows-only check:
    the second grid depends on the first stage's winner)."""
    wide = materialize(_wide(Tables(spark, sf)), "oof_wide")
    sc, fine = EN.weight_search(wide, ["p0", "p1", "p2"], clip_cols=("lo", "hi"))
    cands = spark.createDataFrame([(i, *w) for i, w in enumerate(fine)], "cand_id int, w0 double, w1 double, w2 double")
    g = F.broadcast(cands).join(sc, "cand_id")
    best = g.agg(F.min_by("cand_id", F.struct(F.round("score", 9), F.col("cand_id"))).alias("_best"))
    return (g.crossJoin(F.broadcast(best)).withColumn("is_best", F.col("cand_id") == F.col("_best"))
            .select("cand_id", "w0", "w1", "w2", F.round("score", 6).alias("score"), "is_best"))
