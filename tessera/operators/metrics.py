"""Scores over scored tables: MCRMSE, per-fold CV, classification report, losses.

Inputs are long tables (one row per id and target) so the number of targets is
data, not code; every metric is a partial+final aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, id_cols, targets, pred_prefix: str | None = "pred_",
            target_col: str = "target", y_col: str = "y", pred_col: str = "pred") -> DataFrame:
    """Wide (id, t1.., pred_t1..) -> long (id, target, y[, pred]) via ``stack``."""
    id_cols = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    parts = []
    for t in targets:
        parts += [f"'{t}'", f"CAST(`{t}` AS DOUBLE)"]
        if pred_prefix is not None:
            parts.append(f"CAST(`{pred_prefix}{t}` AS DOUBLE)")
    width = 3 if pred_prefix is not None else 2
    names = f"{target_col}, {y_col}" + (f", {pred_col}" if pred_prefix is not None else "")
    expr = f"stack({len(targets)}, {', '.join(parts)}) AS ({names})"
    del width
    return df.selectExpr(*[f"`{c}`" for c in id_cols], expr)


def rmse_per_target(long: DataFrame, target_col="target", y_col="y", pred_col="pred",
                    by=()) -> DataFrame:
    """sqrt(mean((pred - y)^2)) per target (and per ``by`` keys); null preds skipped."""
    d = long.where(F.col(pred_col).isNotNull() & F.col(y_col).isNotNull())
    return (d.groupBy(*by, target_col)
            .agg(F.sqrt(F.avg(F.pow(F.col(pred_col) - F.col(y_col), 2))).alias("rmse"),
                 F.count(F.lit(1)).alias("n")))


def mcrmse(long: DataFrame, target_col="target", y_col="y", pred_col="pred", by=()) -> DataFrame:
    """Mean over targets of per-target RMSE (mean of roots, not root of mean)."""
    per = rmse_per_target(long, target_col, y_col, pred_col, by)
    return per.groupBy(*by).agg(F.avg("rmse").alias("mcrmse"), F.count(F.lit(1)).alias("n_targets"))


def cv_scores(long: DataFrame, fold_col="kfold", target_col="target", y_col="y",
              pred_col="pred", digits: int = 4) -> DataFrame:
    """Per-fold MCRMSE rounded to ``digits``; plus one row (fold null) with the mean of
    the rounded fold scores, rounded again."""
    per_fold = (mcrmse(long, target_col, y_col, pred_col, by=[fold_col])
                .select(F.col(fold_col).cast("int").alias(fold_col),
                        F.round("mcrmse", digits).alias("score")))
    overall = per_fold.agg(F.round(F.avg("score"), digits).alias("score")) \
        .select(F.lit(None).cast("int").alias(fold_col), "score")
    return per_fold.unionByName(overall)


def classification_report(df: DataFrame, y_col="y", pred_col="pred", by=()) -> DataFrame:
    """Per-class precision / recall / F1 / support plus accuracy and macro averages.

    One shuffle of (y, pred) counts: a confusion table with |classes|^2 rows at most.
    0/0 is 0.  Output: one row per class, plus rows ``class='macro avg'`` and
    ``class='accuracy'`` (accuracy in every metric column of its row).
    """
    from tessera.session import materialize
    by = list(by)
    # the confusion table (|classes|^2 rows per group) feeds four aggregates: write it once
    cm = materialize(df.groupBy(*by, y_col, pred_col).agg(F.count(F.lit(1)).alias("c")), "confusion")
    tp = cm.where(F.col(y_col) == F.col(pred_col)).groupBy(*by, F.col(y_col).alias("cls")) \
        .agg(F.sum("c").alias("tp"))
    sup = cm.groupBy(*by, F.col(y_col).alias("cls")).agg(F.sum("c").alias("support"))
    prd = cm.groupBy(*by, F.col(pred_col).alias("cls")).agg(F.sum("c").alias("predicted"))
    k = [*by, "cls"]
    per = (sup.join(prd, k, "full").join(tp, k, "left")
           .select(*by, F.col("cls").cast("string").alias("class"),
                   F.coalesce("tp", F.lit(0)).alias("tp"),
                   F.coalesce("support", F.lit(0)).alias("support"),
                   F.coalesce("predicted", F.lit(0)).alias("predicted")))

    def safe_div(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    per = per.select(*by, "class", "support",
                     safe_div(F.col("tp"), F.col("predicted")).alias("precision"),
                     safe_div(F.col("tp"), F.col("support")).alias("recall"))
    per = per.withColumn("f1", safe_div(2 * F.col("precision") * F.col("recall"),
                                        F.col("precision") + F.col("recall")))
    macro = per.groupBy(*by).agg(F.lit("macro avg").alias("class"),
                                 F.sum("support").alias("support"),
                                 F.avg("precision").alias("precision"),
                                 F.avg("recall").alias("recall"),
                                 F.avg("f1").alias("f1"))
    acc = (cm.groupBy(*by)
           .agg(F.sum(F.when(F.col(y_col) == F.col(pred_col), F.col("c")).otherwise(0)).alias("hit"),
                F.sum("c").alias("support"))
           .select(*by, F.lit("accuracy").alias("class"), "support",
                   *[(F.col("hit") / F.col("support")).alias(m) for m in ("precision", "recall", "f1")]))
    return per.unionByName(macro).unionByName(acc)


def loss_columns(x, y):
    """Element-wise loss expressions for regression pred ``x`` vs target ``y``."""
    d = x - y
    ad = F.abs(d)
    return {
        "smooth_l1": F.when(ad < 1, 0.5 * d * d).otherwise(ad - 0.5),
        "mae": ad,
        "mse": d * d,
    }


def bce_with_logits(logit, y):
    """Numerically stable binary cross-entropy on a logit."""
    return F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit)))


def focal_loss_binary(logit0, logit1, y, alpha0: float = 0.25, alpha1: float = 0.75, gamma: float = 2.0):
    """Two-class focal loss: -alpha[y] (1 - p_y)^gamma ln p_y with p = softmax(logits)."""
    m = F.greatest(logit0, logit1)
    lse = m + F.log(F.exp(logit0 - m) + F.exp(logit1 - m))
    logp_y = F.when(y == 1, logit1 - lse).otherwise(logit0 - lse)
    p_y = F.exp(logp_y)
    a = F.when(y == 1, F.lit(alpha1)).otherwise(F.lit(alpha0))
    return -a * F.pow(1 - p_y, gamma) * logp_y


def cross_entropy_binary(logit0, logit1, y):
    m = F.greatest(logit0, logit1)
    lse = m + F.log(F.exp(logit0 - m) + F.exp(logit1 - m))
    return lse - F.when(y == 1, logit1).otherwise(logit0)
