"""Leave-fold-out linear regression from sufficient statistics.

One aggregate gives each fold's sums of products of ``[1, features, targets]``; the model
of a fold comes from the total less the fold's own sums, for all targets at once, so k folds
and t targets cost one pass over the rows, not ``k * t`` fits.  What reaches the driver is a
row a fold, whatever the number of rows.

The fit is ridge regression on standardized features with an unpenalized intercept:
``(S + reg * diag(S)) b = s`` on centered second moments.  A feature that is constant in the
training rows gets the coefficient 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _complete(df: DataFrame, cols) -> DataFrame:
    for c in cols:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def fold_moments(df: DataFrame, features, targets, fold_col: str = "kfold") -> DataFrame:
    """(fold, n, sums, products): sums of the columns, and of the products that the fit uses, over the
    rows with a fold in which no feature or target is missing."""
    cols = [*features, *targets]
    x = [F.col(c).cast("double") for c in cols]
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(cols))]
    return _complete(df, cols).where(F.col(fold_col).isNotNull()).groupBy(F.col(fold_col).alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in x]).alias("sums"),
        F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("products"))


def _solve(n: float, sums: np.ndarray, products: np.ndarray, n_features: int, reg: float) -> np.ndarray | None:
    """Coefficients [target, 1 + feature], the intercept first."""
    if n <= 0:
        return None
    p, mean = n_features, sums / n
    second = np.zeros((p, len(sums)))
    at = 0
    for i in range(p):
        second[i, i:] = products[at:at + len(sums) - i]
        at += len(sums) - i
    for i in range(p):
        second[i, :i] = second[:i, i]
    second = second / n - np.outer(mean[:p], mean)
    spread = np.diag(second[:, :p])
    use = spread > 1e-12 * np.maximum(1.0, mean[:p] ** 2)
    coef = np.zeros((p, len(sums) - p))
    if use.any():
        left = second[:, :p][np.ix_(use, use)]
        coef[use] = np.linalg.solve(left + reg * np.diag(spread[use]), second[use][:, p:])
    return np.column_stack([mean[p:] - mean[:p] @ coef, coef.T])


def fold_models(df: DataFrame, features, targets, fold_col: str = "kfold", reg: float = 0.1) -> dict[int, np.ndarray]:
    """{fold: coefficients [target, 1 + feature]} of the model that has not seen the fold."""
    rows = fold_moments(df, features, targets, fold_col).collect()  # a row a fold
    own = {r["fold"]: (r["n"], np.array(r["sums"]), np.array(r["products"])) for r in sorted(rows, key=lambda r: r["fold"])}
    out = {}
    for fold in own:
        rest = [v for f, v in own.items() if f != fold]
        n, sums, products = (sum(x) for x in zip(*rest)) if rest else (0, np.zeros(1), np.zeros(1))
        coef = _solve(n, sums, products, len(features), reg)
        if coef is not None:
            out[int(fold)] = coef
    return out


def _predict(features, coef: np.ndarray) -> Column:
    out = F.lit(float(coef[0]))
    for c, b in zip(features, coef[1:]):
        out = out + F.col(c).cast("double") * F.lit(float(b))
    return out


def cv_regression(df: DataFrame, key: str, features, targets, fold_col: str = "kfold", reg: float = 0.1) -> DataFrame:
    """(key, fold, target, y, pred): every row predicted by the model that has not seen its
    fold.  Rows without a fold are left out; a missing feature gives a null prediction."""
    models = fold_models(df, features, targets, fold_col, reg)
    parts = []
    for i, t in enumerate(targets):
        pred = F.lit(None).cast("double")
        for fold, coef in models.items():
            pred = F.when(F.col(fold_col) == fold, _predict(features, coef[i])).otherwise(pred)
        parts += [F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y"), pred.alias("pred"))]
    out = df.where(F.col(fold_col).isNotNull()).select(key, fold_col, F.explode(F.array(*parts)).alias("_x"))
    return out.select(key, fold_col, "_x.target", "_x.y", "_x.pred")


def fold_inference(train: DataFrame, test: DataFrame, key: str, features, targets, fold_col: str = "kfold",
                   reg: float = 0.1) -> DataFrame:
    """(key, target, pred): the mean prediction of all fold models of ``train`` for every row of ``test``."""
    models = fold_models(train, features, targets, fold_col, reg)
    parts = []
    for i, t in enumerate(targets):
        preds = [_predict(features, coef[i]) for coef in models.values()]
        mean = sum(preds[1:], preds[0]) / len(preds) if preds else F.lit(None).cast("double")
        parts.append(F.struct(F.lit(t).alias("target"), mean.alias("pred")))
    out = test.select(key, F.explode(F.array(*parts)).alias("_x"))
    return out.select(key, "_x.target", "_x.pred")
