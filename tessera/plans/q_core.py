"""Minimum slice: clean -> features -> group folds -> OOF baseline -> MCRMSE; plus splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import clean_text, readability_ari
from tessera.operators import splits
from tessera.operators.metrics import cv_scores, mcrmse, rmse_per_target
from tessera.operators.multilabel import iterative_kfold
from tessera.plans import sql as S
from tessera.plans.common import essay_frame, essay_oof
from tessera.plans.registry import query
from tessera.sources.tables import Tables


@query("clean_text", f"SELECT doc_id, {S.clean('text')} AS clean FROM documents")
def q_clean_text(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", clean_text("text").alias("clean"))


@query("readability_ari", f"SELECT doc_id, round({S.ari('text')}, 6) AS ari FROM documents")
def q_readability_ari(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", F.round(readability_ari("text"), 6).alias("ari"))


@query("essay_features", f"SELECT * FROM ({S.ESSAY})")
def q_essay_features(spark, sf):
    return essay_frame(Tables(spark, sf))


@query("random_kfold", f"""
SELECT doc_id, CAST((row_number() OVER (ORDER BY {S.h(42, 'doc_id')}, doc_id) - 1) % 5 AS INTEGER) AS kfold
FROM documents""")
def q_random_kfold(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id")
    return splits.random_kfold(d, "doc_id", k=5, seed=42)


@query("group_kfold", f"""
WITH r AS ({S.group_folds('documents', 'source')})
SELECT d.doc_id, d.source, r.kfold FROM documents d LEFT JOIN r USING (source)""")
def q_group_kfold(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "source")
    return splits.group_kfold(d, "source", k=5, seed=42).select("doc_id", "source", "kfold")


@query("stratified_kfold", f"""
SELECT doc_id, lang, CAST((row_number() OVER (ORDER BY lang NULLS FIRST, {S.h(42, 'doc_id')}, doc_id) - 1) % 5 AS INTEGER) AS kfold
FROM documents""")
def q_stratified_kfold(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "lang")
    return splits.stratified_kfold(d, "doc_id", "lang", k=5, seed=42).select("doc_id", "lang", "kfold")


@query("stratified_kfold_nulls", f"""
SELECT doc_id, quality, CAST((row_number() OVER (ORDER BY quality NULLS FIRST, {S.h(42, 'doc_id')}, doc_id) - 1) % 5 AS INTEGER) AS kfold
FROM documents LEFT JOIN labels USING (doc_id)""")
def q_stratified_kfold_nulls(spark, sf):
    """Most documents have no label: null is a stratum like the others."""
    t = Tables(spark, sf)
    d = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return splits.stratified_kfold(d, "doc_id", "quality", k=5, seed=42).select("doc_id", "quality", "kfold")


@query("multilabel_kfold", f"""
WITH d AS (
  SELECT doc_id, concat_ws('|', coalesce(CAST(l.quality AS VARCHAR), '∅'), coalesce(CAST(l.toxic AS VARCHAR), '∅'),
                           coalesce(CAST(lang AS VARCHAR), '∅')) AS combo
  FROM documents LEFT JOIN labels l USING (doc_id)),
s AS (SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY combo) >= 5 THEN combo ELSE '~rare' END AS stratum FROM d)
SELECT doc_id, CAST((row_number() OVER (ORDER BY stratum, {S.h(42, 'doc_id')}, doc_id) - 1) % 5 AS INTEGER) AS kfold FROM s""")
def q_multilabel_kfold(spark, sf):
    t = Tables(spark, sf)
    d = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return splits.multilabel_kfold(d, "doc_id", ["quality", "toxic", "lang"], k=5, seed=42).select("doc_id", "kfold")


@query("holdout_split", f"""
SELECT doc_id, (row_number() OVER (ORDER BY {S.h(7, 'doc_id')}, doc_id) - 1) < round_even(0.7 * count(*) OVER (), 0) AS is_train
FROM documents""")
def q_holdout_split(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id")
    return splits.holdout_split(d, "doc_id", frac=0.7, seed=7)


@query("group_holdout", f"""
WITH g AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL),
r AS (SELECT source, (row_number() OVER (ORDER BY {S.h(42, 'source')}, source) - 1) < round_even(0.8 * count(*) OVER (), 0) AS is_train FROM g)
SELECT d.doc_id, d.source, r.is_train FROM documents d LEFT JOIN r USING (source)""")
def q_group_holdout(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "source")
    return splits.group_holdout(d, "source", frac=0.8, seed=42).select("doc_id", "source", "is_train")


@query("group_blocks", f"""
WITH g AS (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL),
r AS (SELECT p_brand, CAST(floor((row_number() OVER (ORDER BY {S.h(42, 'p_brand')}, p_brand) - 1) * 10 / count(*) OVER ()) AS INTEGER) AS block FROM g)
SELECT p.p_partkey, p.p_brand, r.block FROM part p LEFT JOIN r USING (p_brand)""")
def q_group_blocks(spark, sf):
    p = Tables(spark, sf).part.select("p_partkey", "p_brand")
    return splits.group_blocks(p, "p_brand", n_blocks=10, seed=42).select("p_partkey", "p_brand", "block")


@query("fold_slice", f"""
WITH r AS ({S.group_folds('documents', 'source')})
SELECT d.doc_id, r.kfold FROM documents d JOIN r USING (source) WHERE r.kfold <> 2""")
def q_fold_slice(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "source")
    train, _ = splits.fold_slice(splits.group_kfold(d, "source", k=5, seed=42), 2)
    return train.select("doc_id", "kfold")


@query("oof_group_mean", f"""
WITH {S.OOF_CTES}
SELECT doc_id, target, y, kfold, round(pred, 6) AS pred FROM oof""")
def q_oof_group_mean(spark, sf):
    o = essay_oof(Tables(spark, sf))
    return o.select("doc_id", "target", "y", "kfold", F.round("pred", 6).alias("pred"))


@query("mcrmse", f"""
WITH {S.OOF_CTES},
per AS (SELECT target, sqrt(avg((pred - y) * (pred - y))) AS rmse FROM oof WHERE pred IS NOT NULL AND y IS NOT NULL GROUP BY target)
SELECT round(avg(rmse), 6) AS mcrmse, count(*) AS n_targets FROM per""")
def q_mcrmse(spark, sf):
    m = mcrmse(essay_oof(Tables(spark, sf)))
    return m.select(F.round("mcrmse", 6).alias("mcrmse"), "n_targets")


@query("mcrmse_per_target", f"""
WITH {S.OOF_CTES}
SELECT target, round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse, count(*) AS n
FROM oof WHERE pred IS NOT NULL AND y IS NOT NULL GROUP BY target""")
def q_mcrmse_per_target(spark, sf):
    r = rmse_per_target(essay_oof(Tables(spark, sf)))
    return r.select("target", F.round("rmse", 6).alias("rmse"), "n")


@query("cv_scores", f"""
WITH {S.OOF_CTES},
per AS (SELECT kfold, target, sqrt(avg((pred - y) * (pred - y))) AS rmse FROM oof WHERE pred IS NOT NULL AND y IS NOT NULL GROUP BY kfold, target),
fs AS (SELECT CAST(kfold AS INTEGER) AS kfold, round(avg(rmse), 4) AS score FROM per GROUP BY kfold)
SELECT kfold, score FROM fs UNION ALL SELECT CAST(NULL AS INTEGER), round(avg(score), 4) FROM fs""")
def q_cv_scores(spark, sf):
    return cv_scores(essay_oof(Tables(spark, sf)))


def _steps(expr: str) -> str:
    return f"CAST(greatest(0, least(8, {expr})) AS INT)"


#: six targets of nine steps each, in SQL that both engines read alike
TARGETS = {
    "t_chars": _steps("floor(log2(n_chars + 1)) - 4"), "t_lines": _steps("length(text) - length(replace(text, chr(10), ''))"),
    "t_commas": _steps("floor((length(text) - length(replace(text, ',', ''))) / 4.0)"),
    "t_stops": _steps("floor(sqrt(length(text) - length(replace(text, '.', ''))))"),
    "t_site": _steps("CAST(substr(source, 4) AS INT) % 9"), "t_shape": _steps("length(text) % 13"),
}


@query("multilabel_shares", f"""
WITH d AS (SELECT doc_id, {', '.join(f'{x} AS {c}' for c, x in TARGETS.items())} FROM documents),
l AS ({' UNION ALL '.join(f"SELECT '{c}' AS target, {c} AS step FROM d" for c in TARGETS)})
SELECT target, step, count(*) AS n, TRUE AS even FROM l GROUP BY target, step""")
def q_multilabel_shares(spark, sf):
    """Six targets of nine steps dealt to five folds at once: rows of every label, and whether each
    fold has a fifth of them, to two rows and two hundredths."""
    d = Tables(spark, sf).documents.selectExpr("doc_id", *[f"{x} AS {c}" for c, x in TARGETS.items()])
    folds = iterative_kfold(d, "doc_id", list(TARGETS), k=5)
    long = folds.selectExpr("kfold", f"stack({len(TARGETS)}, {', '.join(f'{chr(39)}{c}{chr(39)}, {c}' for c in TARGETS)}) AS (target, step)")
    per = long.groupBy("target", "step").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum((F.col("kfold") == f).cast("long")).alias(f"n{f}") for f in range(5)])
    even = F.lit(True)
    for f in range(5):
        even = even & (F.abs(F.col(f"n{f}") - F.col("n") / 5) <= 2 + 0.02 * F.col("n"))
    return per.select("target", "step", "n", even.alias("even"))
