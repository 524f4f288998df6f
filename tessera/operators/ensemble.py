"""Ensembles over prediction tables in long form (id, target, run/model, pred)."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clip(c, lo, hi):
    return F.greatest(F.least(c, hi), lo)


def weighted_ensemble(preds: DataFrame, weights: DataFrame, keys, run_col: str = "run",
                      pred_col: str = "pred", weight_col: str = "weight", out: str = "pred") -> DataFrame:
    """sum(w * p) / sum(w) per key; the weight table has one row per run (broadcast-sized)."""
    j = preds.join(F.broadcast(weights), run_col)
    return j.groupBy(*keys).agg((F.sum(F.col(weight_col) * F.col(pred_col)) / F.sum(weight_col)).alias(out))


def vote_weights(runs, first: int = 5, w_first: float = 0.2, w_rest: float = 0.07):
    """Fixed vote weights: ``w_first`` each for the first runs, ``w_rest`` after."""
    return [(r, w_first if i < first else w_rest) for i, r in enumerate(runs)]


def vote_ensemble(classes: DataFrame, weights: DataFrame, keys, run_col: str = "run",
                  class_col: str = "cls", threshold: float = 0.5) -> DataFrame:
    """Weighted sum of hard 0/1 votes, then ``>= threshold``."""
    j = classes.join(F.broadcast(weights), run_col)
    s = j.groupBy(*keys).agg(F.sum(F.col("weight") * F.col(class_col)).alias("score"))
    return s.withColumn("pred", (F.col("score") >= threshold).cast("int"))


def fold_vote(preds: DataFrame, keys, pred_col: str = "pred") -> DataFrame:
    """Round each fold's prediction half-to-even, average, round again."""
    return preds.groupBy(*keys).agg(F.rint(F.avg(F.rint(pred_col))).alias("vote"))


def fold_argmax(scores: DataFrame, keys, class_col: str = "cls", score_col: str = "score") -> DataFrame:
    """Average class scores over folds, then the best class (ties: lowest class)."""
    avg = scores.groupBy(*keys, class_col).agg(F.avg(score_col).alias("_avg"))
    # highest average wins; among equal averages the lowest class
    return avg.groupBy(*keys).agg(F.min_by(F.col(class_col), F.struct(-F.col("_avg"), F.col(class_col))).alias("pred"))


def model_mean_pivot(scores: DataFrame, key: str, class_col: str, score_col: str, levels) -> DataFrame:
    """Mean over models per (key, class), one column per class level (levels given,
    so the pivot needs no extra pass to discover them)."""
    return scores.groupBy(key).pivot(class_col, list(levels)).agg(F.avg(score_col))


def simplex_grid(n_runs: int, step: float = 0.1):
    """All weight vectors on a simplex grid (weights >= 0 summing to 1)."""
    m = int(round(1 / step))
    out = []
    for combo in itertools.product(range(m + 1), repeat=n_runs - 1):
        if sum(combo) <= m:
            out.append([c / m for c in combo] + [(m - sum(combo)) / m])
    return out


#: candidates scored by one aggregate
BLOCK = 40


def score_candidates(wide: DataFrame, candidates, pred_cols, target_col="target", y_col="y",
                     clip_cols=None) -> DataFrame:
    """Exact clipped MCRMSE of every candidate weight vector over an OOF table.

    ``candidates`` is a bounded list of weight vectors (a grid or a population); a block
    of them is one aggregate with an average per candidate, so rows do not multiply.
    """
    def loss(ws):
        p = sum((F.lit(float(w)) * F.col(c) for w, c in zip(ws, pred_cols)), F.lit(0.0))
        if clip_cols is not None:
            p = clip(p, F.col(clip_cols[0]), F.col(clip_cols[1]))
        return F.avg(F.pow(p - F.col(y_col), 2))
    per = None
    for at in range(0, len(candidates), BLOCK):
        block = candidates[at:at + BLOCK]
        one = wide.groupBy(target_col).agg(*[loss(ws).alias(f"_{i}") for i, ws in enumerate(block)])
        one = one.select(target_col, F.explode(F.array(*[
            F.struct(F.lit(at + i).alias("cand_id"), F.sqrt(f"_{i}").alias("_rmse")) for i in range(len(block))])).alias("_c"))
        per = one if per is None else per.unionByName(one)
    return per.select(target_col, "_c.*").groupBy("cand_id").agg(F.avg("_rmse").alias("score"))


def roulette_cumshare(cands: DataFrame, obj_col: str = "score", id_col: str = "cand_id") -> DataFrame:
    """Selection probabilities of a minimizing objective: fitness ``max - obj + 1``
    (objectives shifted to be non-negative first), cumulative share in id order.
    The candidate table is bounded (a population), so one ordered window is fine."""
    st = cands.agg(F.min(obj_col).alias("_mn"), F.max(obj_col).alias("_mx"))
    shift = F.when(F.col("_mn") < 0, -F.col("_mn")).otherwise(F.lit(0.0))
    f = cands.crossJoin(F.broadcast(st)).withColumn("fitness", (F.col("_mx") + shift) - (F.col(obj_col) + shift) + 1)
    w = Window.orderBy(id_col).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy()
    return f.select(id_col, obj_col, "fitness",
                    (F.sum("fitness").over(w) / F.sum("fitness").over(tot)).alias("cum_share"))


def refine_grid(best, step: float = 0.02, radius: float = 0.1):
    """Simplex points within ``radius`` of ``best`` (per weight) on a finer ``step``;
    the last weight closes the sum to one.  A bounded candidate list."""
    m = int(round(radius / step))
    offsets = [k * step for k in range(-m, m + 1)]
    out = []

    def rec(prefix, i):
        if i == len(best) - 1:
            last = 1.0 - sum(prefix)
            if last >= -1e-12 and abs(last - best[-1]) <= radius + 1e-12:
                out.append([round(x, 10) for x in prefix] + [round(max(last, 0.0), 10)])
            return
        for o in offsets:
            w = best[i] + o
            if w >= -1e-12:
                rec(prefix + [max(w, 0.0)], i + 1)
    rec([], 0)
    return out


def weight_search(wide: DataFrame, pred_cols, coarse_step: float = 0.1, fine_step: float = 0.02,
                  radius: float = 0.1, **kw):
    """Two-stage exact search: a coarse simplex grid, then a finer grid around the
    best point.  Each stage is one Spark job over the whole OOF table; only the
    best weight vector (one row) returns to the driver between stages.
    Returns (scored fine candidates DataFrame, fine candidate list)."""
    coarse = simplex_grid(len(pred_cols), coarse_step)
    sc = score_candidates(wide, coarse, pred_cols, **kw)
    best_id = sc.agg(F.min_by("cand_id", F.struct(F.round("score", 9), F.col("cand_id")))).first()[0]
    fine = refine_grid(coarse[best_id], fine_step, radius)
    return score_candidates(wide, fine, pred_cols, **kw), fine


def _simplex_least(h: np.ndarray, c: np.ndarray, w: np.ndarray, turns: int = 4000) -> np.ndarray:
    """Least point of ``w'hw / 2 - c'w`` over the simplex, from ``w``, by projected gradients."""
    step = 1 / max(np.linalg.eigvalsh(h)[-1], 1e-12)
    far, t = w, 1.0
    for _ in range(turns):  # accelerated; a few numbers a weight
        v = far - step * (h @ far - c)
        u = np.sort(v)[::-1]
        k = np.flatnonzero(u - (np.cumsum(u) - 1) / np.arange(1, len(u) + 1) > 0)[-1]
        new = np.maximum(v - (u[:k + 1].sum() - 1) / (k + 1), 0)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        far, w, t = new + (t - 1) / after * (new - w), new, after
    return w


def descend_weights(wide: DataFrame, pred_cols, target_col="target", y_col="y", clip_cols=None, turns: int = 8,
                    gain: float = 1e-9) -> tuple[list[float], float]:
    """(weights, score): descent on the simplex of any number of runs, without enumeration.

    An iteration is one aggregate with a row a target: the exact clipped error of the present
    weights, and the moments of the rows that are not clipped, which give its gradient and
    curvature.  The least point of that model over the simplex is the direction; a second
    aggregate scores a few steps towards it exactly, and the best is taken.  The score
    never rises; rows with a missing prediction are left out."""
    cols = list(pred_cols)
    rows = wide
    for c in (*cols, y_col):
        rows = rows.where(F.col(c).isNotNull())
    w, best = np.full(len(cols), 1 / len(cols)), None
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    for _ in range(turns):
        p = sum((F.lit(float(x)) * F.col(c) for x, c in zip(w, cols)), F.lit(0.0))
        free, shown = F.lit(1.0), p
        if clip_cols is not None:
            lo, hi = (F.col(c) for c in clip_cols)
            free, shown = F.when((p >= lo) & (p <= hi), 1.0).otherwise(0.0), clip(p, lo, hi)
        stats = rows.groupBy(target_col).agg(
            F.avg(F.pow(shown - F.col(y_col), 2)).alias("mse"),
            F.array(*[F.avg(free * F.col(cols[i]) * F.col(cols[j])) for i, j in pairs]).alias("h"),
            F.array(*[F.avg(free * F.col(c) * F.col(y_col)) for c in cols]).alias("c")).orderBy(target_col).collect()
        if not stats:
            return w.tolist(), float("nan")
        score = float(np.mean([r["mse"] ** 0.5 for r in stats]))
        best = score if best is None else best
        h, c = np.zeros((len(cols), len(cols))), np.zeros(len(cols))
        for r in stats:  # a target weighs as the slope of its root
            slope = 1 / (max(r["mse"], 1e-18) ** 0.5 * len(stats))
            for (i, j), x in zip(pairs, r["h"]):
                h[i, j] += slope * x
                h[j, i] = h[i, j]
            c += slope * np.array(r["c"])
        aim = _simplex_least(h, c, w)
        steps = [w + s * (aim - w) for s in (1.0, 0.6, 0.3, 0.1, 0.03)]
        scored = {r["cand_id"]: r["score"] for r in
                  score_candidates(rows, [x.tolist() for x in steps], cols, target_col, y_col, clip_cols).collect()}
        k = min(scored, key=lambda i: (scored[i], i))
        if scored[k] > best - gain:
            return w.tolist(), best
        w, best = steps[k], scored[k]
    return w.tolist(), float(best)
