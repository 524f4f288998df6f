"""Out-of-fold tables: group-mean baseline, fold selection, fold averaging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import join_null_safe


def oof_group_mean(long: DataFrame, group_col: str, fold_col: str = "kfold",
                   target_col: str = "target", y_col: str = "y", out: str = "pred") -> DataFrame:
    """Predict each row by the mean of its group *in the other folds*.

    Closed form ``(S_g - S_gf) / (N_g - N_gf)``; when a group lives in one fold
    only, the global other-fold mean ``(S - S_f) / (N - N_f)`` is used (null if
    there is a single fold).  Only aggregates are joined back: no row sees another.
    """
    # exact decimal sums: the result does not depend on summation order
    yd = F.col(y_col).cast("decimal(38,6)")
    gf = long.groupBy(group_col, fold_col, target_col).agg(F.sum(yd).alias("_sgf"), F.count(y_col).alias("_ngf"))
    g = gf.groupBy(group_col, target_col).agg(F.sum("_sgf").alias("_sg"), F.sum("_ngf").alias("_ng"))
    f = gf.groupBy(fold_col, target_col).agg(F.sum("_sgf").alias("_sf"), F.sum("_ngf").alias("_nf"))
    a = gf.groupBy(target_col).agg(F.sum("_sgf").alias("_s"), F.sum("_ngf").alias("_n"))
    stats = (join_null_safe(join_null_safe(join_null_safe(gf, g, [group_col, target_col]), f, [fold_col, target_col]),
                            a, [target_col])
             .select(group_col, fold_col, target_col,
                     F.when(F.col("_ng") > F.col("_ngf"),
                            (F.col("_sg") - F.col("_sgf")).cast("double") / (F.col("_ng") - F.col("_ngf")))
                     .when(F.col("_n") > F.col("_nf"),
                           (F.col("_s") - F.col("_sf")).cast("double") / (F.col("_n") - F.col("_nf")))
                     .alias(out)))
    return join_null_safe(long, stats, [group_col, fold_col, target_col], "left")


def oof_select(preds: DataFrame, fold_col: str = "kfold", model_fold_col: str = "model_fold") -> DataFrame:
    """Keep, for each row, only the prediction of the model that did not train on it."""
    return preds.where(F.col(model_fold_col) == F.col(fold_col))


def fold_average(preds: DataFrame, keys, pred_col: str = "pred", out: str = "pred") -> DataFrame:
    """Average of fold-model predictions per key (test-time inference)."""
    return preds.groupBy(*keys).agg(F.avg(pred_col).alias(out), F.count(F.lit(1)).alias("n_models"))


def fold_model_predictions(long: DataFrame, group_col: str, k: int, fold_col: str = "kfold",
                           target_col: str = "target", y_col: str = "y", model_col: str = "model_fold",
                           out: str = "pred", own_fold_only: bool = False) -> DataFrame:
    """Predictions of the ``k`` fold models of a group-mean regressor for every row.

    Model ``m`` is fitted on folds other than ``m``: it predicts the mean of the
    row's group over those folds, or the overall mean over those folds when the
    group has no rows there.  Statistics are aggregates per (group, fold) crossed
    with the ``k`` model ids (a bounded table), then joined back to the rows, so a
    row gets ``k`` predictions without any row-to-row pairing.  The k model ids
    fan out by ``explode`` of a literal sequence (a bounded multiplier, no join).  With
    ``own_fold_only`` each row is joined only to the model of its own fold (the
    out-of-fold prediction), one row out per row in.
    """
    yd = F.col(y_col).cast("decimal(38,6)")
    gf = long.groupBy(group_col, fold_col, target_col).agg(F.sum(yd).alias("_s"), F.count(y_col).alias("_n"))
    model_ids = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(model_col)
    per_model = gf.select("*", model_ids).where(F.col(fold_col) != F.col(model_col))
    gm = per_model.groupBy(group_col, target_col, model_col).agg(F.sum("_s").alias("_sg"), F.sum("_n").alias("_ng"))
    am = per_model.groupBy(target_col, model_col).agg(F.sum("_s").alias("_sa"), F.sum("_n").alias("_na"))
    grid = long.select(group_col, target_col).distinct().select("*", model_ids)
    grid = join_null_safe(grid, gm, [group_col, target_col, model_col], "left")
    grid = (join_null_safe(grid, am, [target_col, model_col], "left")
            .select(group_col, target_col, model_col,
                    F.when(F.col("_ng") > 0, F.col("_sg").cast("double") / F.col("_ng"))
                    .when(F.col("_na") > 0, F.col("_sa").cast("double") / F.col("_na")).alias(out)))
    if own_fold_only:
        g = grid.withColumnRenamed(model_col, fold_col)
        return join_null_safe(long, g, [group_col, target_col, fold_col]).withColumn(model_col, F.col(fold_col))
    return join_null_safe(long, grid, [group_col, target_col])
