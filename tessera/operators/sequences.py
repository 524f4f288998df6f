"""Step-log windows: running weighted mean, moving mean, early stopping, leaderboard.

Every window is partitioned by run; the leaderboard's places come from a distributed
sort, never from a window over a whole table in one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def step_log(df: DataFrame, run_col: str, order_cols, score_col: str, per_epoch: int = 3,
             largest_group: int | None = None) -> DataFrame:
    """Rows of each run numbered in order: step (0-based) and epoch = step // per_epoch.

    Numbering is a segmented count over the first order key (microseconds for
    timestamps), so one very long run is not numbered by a single task."""
    from tessera.operators.ranking import segmented_cumsum
    first = order_cols[0]
    key = "_okey"
    d = df.withColumn(key, F.unix_micros(F.col(first).cast("timestamp"))
                      if dict(df.dtypes).get(first, "").startswith("timestamp") else F.col(first))
    d = segmented_cumsum(d, [run_col], [key, *order_cols[1:]], F.lit(1), "_n", largest_group=largest_group).drop(key)
    return (d.withColumn("step", F.col("_n") - 1).drop("_n")
            .withColumn("epoch", F.floor(F.col("step") / per_epoch).cast("bigint"))
            .withColumn("score", F.col(score_col).cast("double")))


def running_mean(df: DataFrame, run_col: str, order_col: str, val_col: str, n_col: str,
                 largest_group: int | None = None) -> DataFrame:
    """Running (val, sum, count, avg) with weights n, as an online average meter does
    (segmented running sums: a long run is not summed by one task)."""
    from tessera.operators.ranking import segmented_cumsums
    d = segmented_cumsums(df, [run_col], [order_col],
                          {"run_sum": F.col(val_col) * F.col(n_col), "run_count": F.col(n_col)},
                          largest_group=largest_group)
    return d.withColumn("run_avg", F.col("run_sum") / F.col("run_count"))


def moving_mean(df: DataFrame, run_col: str, order_col: str, val_col: str, width: int = 1000,
                largest_group: int | None = None) -> DataFrame:
    """Mean of the last ``width`` values of each run: prefix sums (segmented) and
    the prefix ``width`` steps back, matched by an equi-join on (run, position),
    so a long run is never windowed in one task.  Rows without a run are one run."""
    from tessera.operators.ranking import join_null_safe, segmented_cumsums
    d = segmented_cumsums(df, [run_col], [order_col], {"_cs": F.col(val_col), "_pos": F.lit(1)},
                          largest_group=largest_group)
    back = d.select(run_col, (F.col("_pos") + width).alias("_pos"), F.col("_cs").alias("_cs_back"))
    j = join_null_safe(d, back, [run_col, "_pos"], "left")
    n = F.least(F.col("_pos"), F.lit(width))
    return j.withColumn("moving_avg", (F.col("_cs") - F.coalesce("_cs_back", F.lit(0))) / n).drop(
        "_cs", "_pos", "_cs_back")


def early_stopping(log: DataFrame, run_col: str = "run", step_col: str = "step", epoch_col: str = "epoch",
                   score_col: str = "score", patience: int = 6, max_epoch: float = 1e6, min_epoch: int = 0,
                   at_last_score: float = float("-inf"), mode: str = "max",
                   largest_group: int | None = None) -> DataFrame:
    """Early-stopping flags per scored step, as a pure window query.

    A score improves when it beats every earlier non-NaN score (NaN never
    improves; ``mode='min'`` flips the sign).  Patience counts *epochs* since the
    best epoch.  ``stop_now`` marks steps where the rule fires, ``stopped`` is true
    from the first such step on.
    """
    from tessera.operators.ranking import segmented_cumsums
    from tessera.session import materialize
    s = F.col(score_col) if mode == "max" else -F.col(score_col)
    g, order = [run_col], [step_col]
    plain = largest_group is not None and largest_group <= (1 << 20)

    def cut(df, name):
        # each segmented pass reads its input several times: write it once
        return df if plain else materialize(df, name)
    lg = dict(largest_group=largest_group)
    x = cut(log.withColumn("_s", s).withColumn("_clean", F.when(~F.isnan("_s"), F.col("_s"))), "step_log")
    # running maxima are segmented per run (a very long run is not one task)
    x = segmented_cumsums(x, g, order, {"_best_before": "_clean"}, inclusive=False, agg="max", **lg)
    x = x.withColumn("improved", F.coalesce(~F.isnan("_s") & (F.col("_s") > F.coalesce("_best_before", F.lit(float("-inf")))),
                                            F.lit(False)))
    x = cut(x.withColumn("_imp_epoch", F.when(F.col("improved"), F.col(epoch_col))), "step_log_best")
    x = segmented_cumsums(x, g, order, {"_best_epoch_before": "_imp_epoch"}, inclusive=False, agg="max", **lg)
    be = F.coalesce("_best_epoch_before", F.lit(0))
    x = (x.withColumn("best", F.when(F.col("improved"), F.col("_s")).otherwise(F.col("_best_before")))
         .withColumn("best_epoch", F.when(F.col("improved"), F.col(epoch_col)).otherwise(be))
         .withColumn("counter", F.when(F.col("improved"), F.lit(0)).otherwise(F.col(epoch_col) - be)))
    fire = ((~F.col("improved") & (F.col("counter") >= patience)
             & (F.coalesce("_best_before", F.lit(float("-inf"))) > F.lit(at_last_score))
             & (F.col(epoch_col) >= min_epoch)) | (F.col(epoch_col) >= F.lit(max_epoch)))
    x = cut(x.withColumn("stop_now", fire).withColumn("_stop_i", F.col("stop_now").cast("int")), "step_log_stop")
    x = segmented_cumsums(x, g, order, {"_stopped": "_stop_i"}, inclusive=True, agg="max", **lg)
    x = x.withColumn("stopped", F.col("_stopped") == 1)
    return x.drop("_s", "_clean", "_best_before", "_imp_epoch", "_best_epoch_before", "_stop_i", "_stopped")


def leaderboard(df: DataFrame, score_col: str, desc_col: str, key_col: str, sep: str = "|",
                only: str | None = None) -> DataFrame:
    """Every scored row in order of score (ties by key), its place from 1, by description
    prefix: rows, best, mean and worst place.  ``only`` keeps descriptions that match it;
    places are those among all rows.  The order is a distributed sort."""
    from tessera.operators.ranking import sort_with_position
    pre = F.split(F.col(desc_col), "\\" + sep if sep in "|.*+?^$()[]{}\\" else sep).getItem(0)
    rows = df.where(F.col(score_col).isNotNull()).select(score_col, key_col, F.col(desc_col), pre.alias("prefix"))
    ranked = sort_with_position(rows, [F.desc(score_col), F.asc(key_col)], "_place")
    ranked = ranked if only is None else ranked.where(F.col(desc_col).rlike(only))
    place = F.col("_place") + 1
    return ranked.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("best_rank"),
                                        F.avg(place).alias("mean_rank"), F.max(place).alias("worst_rank"))
