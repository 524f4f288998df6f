"""Leave-fold-out regression on numeric text features, with the same algebra in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import ari_parts, readability_ari
from tessera.operators import foldreg
from tessera.operators.metrics import rmse_per_target
from tessera.operators.splits import group_kfold, holdout_split
from tessera.plans import sql as S
from tessera.plans.common import ESSAY_TARGETS
from tessera.plans.registry import query
from tessera.session import materialize
from tessera.sources.tables import Tables

FEATURES = ["x_lines", "x_words", "x_commas"]
REG = 0.1


def numeric_essays(t: Tables):
    """doc_id, source, three numeric features and the three essay targets."""
    chars, words, _ = ari_parts("text")
    return t.documents.select(
        "doc_id", "source",
        F.size(F.split("text", "\n", -1)).cast("double").alias("x_lines"),
        F.log1p(words).alias("x_words"),
        F.sqrt(F.length("text") - F.length(F.regexp_replace("text", ",", ""))).alias("x_commas"),
        F.round(readability_ari("text"), 6).alias("t_ari"),
        F.round(chars / F.greatest(words, F.lit(1)), 6).alias("t_wlen"),
        F.round(F.log1p("n_chars"), 6).alias("t_loglen"))


def _folds(t: Tables, k: int):
    return materialize(group_kfold(numeric_essays(t), "source", k=k, seed=42), "essay_numeric")


ESSAY_NUM = f"""
SELECT doc_id, source, CAST(len(string_split(text, chr(10))) AS DOUBLE) AS x0,
       ln(1 + {S.ari_words('text')}) AS x1,
       sqrt(length(text) - length(replace(text, ',', ''))) AS x2,
       round({S.ari('text')}, 6) AS y0,
       round({S.ari_chars('text')} / greatest({S.ari_words('text')}, 1), 6) AS y1,
       round(ln(1 + n_chars), 6) AS y2
FROM documents
"""


def model_ctes(src: str) -> str:
    """``model`` (fold, b00..b32): Gaussian elimination of the centered normal equations of
    every fold's training rows, a step a CTE; ``src`` has fold, x0..x2, y0..y2."""
    cols = ["x0", "x1", "x2", "y0", "y1", "y2"]
    cov = ", ".join(f"avg({a} * {b}) - avg({a}) * avg({b}) AS s{i}{j}"
                    for i, a in enumerate(cols[:3]) for j, b in enumerate(cols) if j >= i or j >= 3)
    mean = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(cols))

    def cell(i, j):
        lo, hi = (min(i, j), max(i, j)) if j < 3 else (i, j)
        return f"s{lo}{hi}" + (f" * {1 + REG}" if i == j else "")
    out = [f"f AS (SELECT DISTINCT fold FROM {src} WHERE fold IS NOT NULL)",
           f"c AS (SELECT f.fold, {cov}, {mean} FROM f JOIN {src} d ON d.fold <> f.fold GROUP BY f.fold)",
           "e0 AS (SELECT fold, m0, m1, m2, m3, m4, m5, " + ", ".join(f"{cell(i, j)} AS a{i}{j}" for i in range(3) for j in range(6)) + " FROM c)"]
    for k in range(3):  # clears column k of the rows below it
        rest = [f"a{i}{j} - a{i}{k} / a{k}{k} * a{k}{j} AS a{i}{j}" if i > k else f"a{i}{j}" for i in range(3) for j in range(6)]
        out.append(f"e{k + 1} AS (SELECT fold, m0, m1, m2, m3, m4, m5, {', '.join(rest)} FROM e{k})")
    out.append("b2 AS (SELECT *, " + ", ".join(f"a2{t} / a22 AS b{t}2" for t in (3, 4, 5)) + " FROM e3)")
    out.append("b1 AS (SELECT *, " + ", ".join(f"(a1{t} - a12 * b{t}2) / a11 AS b{t}1" for t in (3, 4, 5)) + " FROM b2)")
    out.append("b0 AS (SELECT *, " + ", ".join(f"(a0{t} - a01 * b{t}1 - a02 * b{t}2) / a00 AS b{t}0" for t in (3, 4, 5)) + " FROM b1)")
    out.append("model AS (SELECT *, " + ", ".join(f"m{t} - m0 * b{t}0 - m1 * b{t}1 - m2 * b{t}2 AS i{t}" for t in (3, 4, 5)) + " FROM b0)")
    return ",\n".join(out)


def _pred(t: int) -> str:
    return f"m.i{t} + m.b{t}0 * x0 + m.b{t}1 * x1 + m.b{t}2 * x2"


def _long(src: str, extra: str) -> str:
    return " UNION ALL ".join(f"SELECT d.doc_id, {extra}'{name}' AS target, CAST(y{i} AS DOUBLE) AS y, {_pred(i + 3)} AS pred FROM {src}"
                              for i, name in enumerate(ESSAY_TARGETS))


OOF = f"""
num AS ({ESSAY_NUM}),
folds AS ({S.group_folds('num', 'source')}),
d AS (SELECT num.*, kfold AS fold FROM num JOIN folds USING (source)),
{model_ctes('d')},
oof AS ({_long('d JOIN model m USING (fold)', 'd.fold AS kfold, ')})
"""


def _oof(spark, sf):
    return foldreg.cv_regression(_folds(Tables(spark, sf), 5), "doc_id", FEATURES, ESSAY_TARGETS, reg=REG)


@query("cv_regression", f"WITH {OOF} SELECT doc_id, kfold, target, y, round(pred, 5) AS pred FROM oof")
def q_cv_regression(spark, sf):
    """Each fold's regressors from the moments of the other folds, all targets at once."""
    return _oof(spark, sf).withColumn("pred", F.round("pred", 5))


@query("oof_score", f"""
WITH {OOF},
per AS (SELECT target, sqrt(avg((pred - y) * (pred - y))) AS rmse, count(*) AS n FROM oof GROUP BY target)
SELECT target, round(rmse, 5) AS rmse, n FROM per
UNION ALL SELECT 'MCRMSE', round(avg(rmse), 5), CAST(sum(n) AS BIGINT) FROM per""")
def q_oof_score(spark, sf):
    per = rmse_per_target(_oof(spark, sf))
    tot = per.agg(F.lit("MCRMSE").alias("target"), F.avg("rmse").alias("rmse"), F.sum("n").alias("n"))
    return per.unionByName(tot).withColumn("rmse", F.round("rmse", 5))


@query("test_inference", f"""
WITH num AS ({ESSAY_NUM}),
r AS (SELECT *, (row_number() OVER (ORDER BY {S.h(7, 'doc_id')}, doc_id) - 1) < round_even(0.7 * count(*) OVER (), 0) AS is_train FROM num),
tr AS (SELECT * FROM r WHERE is_train),
folds AS ({S.group_folds('tr', 'source', k=3)}),
d AS (SELECT tr.*, kfold AS fold FROM tr JOIN folds USING (source)),
{model_ctes('d')},
p AS ({_long('(SELECT * FROM r WHERE NOT is_train) d, model m', '')})
SELECT doc_id, target, round(avg(pred), 5) AS pred FROM p GROUP BY ALL""")
def q_test_inference(spark, sf):
    """Fold models of the training share score the held-out rows; mean over the models."""
    e = materialize(holdout_split(numeric_essays(Tables(spark, sf)), "doc_id", frac=0.7, seed=7), "essay_holdout")
    train = group_kfold(e.where("is_train"), "source", k=3, seed=42)
    test = e.where(~F.col("is_train"))
    out = foldreg.fold_inference(train, test, "doc_id", FEATURES, ESSAY_TARGETS, reg=REG)
    return out.withColumn("pred", F.round("pred", 5))
