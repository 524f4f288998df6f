"""Step-log and leaderboard plans over ``events`` (user = run, value = score)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sequences as SQ
from tessera.plans.registry import ORACLES, query
from tessera.sources.tables import Tables

STEPS_SQL = """
s AS (SELECT event_id, user_id, value AS score, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events),
e AS (SELECT *, step // 3 AS epoch FROM s)
"""


def run_bound(t):
    """Rows in the longest run (checked on the source table)."""
    from tessera.operators.ranking import largest_group
    return largest_group(t.events, ["user_id"])


def steps(t, bound=None):
    e = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return SQ.step_log(e, "user_id", ["ts", "event_id"], "value", largest_group=bound)


def _avg6(cents, n):
    """Half-up mean at 6 places in exact integer arithmetic (inputs are non-negative cents)."""
    return f"CAST((2 * ({cents}) * 10000 + ({n})) // (2 * ({n})) AS DOUBLE) / 1000000"


@query("running_mean", f"""
WITH {STEPS_SQL},
c AS (SELECT *, CAST(CAST(score AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents, 1 + k % 4 AS n FROM e),
r AS (SELECT event_id, user_id, step, n, sum(cents * n) OVER w AS sc, sum(n) OVER w AS run_count
      FROM c WINDOW w AS (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, step, n, CAST(sc AS DOUBLE) / 100 AS run_sum, run_count, {_avg6('sc', 'run_count')} AS run_avg FROM r""")
def q_running_mean(spark, sf):
    """Running weighted mean of 2-decimal scores in exact decimal arithmetic."""
    t = Tables(spark, sf)
    b = run_bound(t)
    s = steps(t, b).withColumn("n", 1 + F.col("k") % 4) \
        .withColumn("score", F.col("score").cast("decimal(18,2)"))
    r = SQ.running_mean(s, "user_id", "step", "score", "n", largest_group=b)
    return r.select("event_id", "user_id", "step", "n", F.col("run_sum").cast("double").alias("run_sum"), "run_count",
                    F.round("run_avg", 6).cast("double").alias("run_avg"))


@query("moving_mean", f"""
WITH {STEPS_SQL},
c AS (SELECT *, CAST(CAST(score AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents FROM e),
m AS (SELECT event_id, user_id, sum(cents) OVER w AS sc, count(*) OVER w AS n
      FROM c WINDOW w AS (PARTITION BY user_id ORDER BY step ROWS BETWEEN 999 PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, {_avg6('sc', 'n')} AS moving_avg FROM m""")
def q_moving_mean(spark, sf):
    t = Tables(spark, sf)
    b = run_bound(t)
    s = steps(t, b).withColumn("score", F.col("score").cast("decimal(18,2)"))
    m = SQ.moving_mean(s, "user_id", "step", "score", 1000, largest_group=b)
    return m.select("event_id", "user_id", F.round("moving_avg", 6).cast("double").alias("moving_avg"))


@query("running_mean_segmented", ORACLES["running_mean"])
def q_running_mean_segmented(spark, sf):
    """The same without a size check: every run in sub-ranges."""
    s = steps(Tables(spark, sf)).withColumn("n", 1 + F.col("k") % 4).withColumn("score", F.col("score").cast("decimal(18,2)"))
    r = SQ.running_mean(s, "user_id", "step", "score", "n")
    return r.select("event_id", "user_id", "step", "n", F.col("run_sum").cast("double").alias("run_sum"), "run_count",
                    F.round("run_avg", 6).cast("double").alias("run_avg"))


@query("moving_mean_10", ORACLES["moving_mean"].replace("999 PRECEDING", "9 PRECEDING"))
def q_moving_mean_10(spark, sf):
    """A width that runs exceed, in sub-ranges."""
    s = steps(Tables(spark, sf)).withColumn("score", F.col("score").cast("decimal(18,2)"))
    m = SQ.moving_mean(s, "user_id", "step", "score", 10)
    return m.select("event_id", "user_id", F.round("moving_avg", 6).cast("double").alias("moving_avg"))


EARLY_SQL = f"""
{STEPS_SQL},
b AS (SELECT *, max(CASE WHEN isnan(score) THEN NULL ELSE score END) OVER p AS best_before FROM e
      WINDOW p AS (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, coalesce(NOT isnan(score) AND score > coalesce(best_before, '-inf'::DOUBLE), false) AS improved FROM b),
j AS (SELECT *, max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS beb FROM i),
k2 AS (SELECT *, CASE WHEN improved THEN score ELSE best_before END AS best,
              CASE WHEN improved THEN epoch ELSE coalesce(beb, 0) END AS best_epoch,
              CASE WHEN improved THEN 0 ELSE epoch - coalesce(beb, 0) END AS counter FROM j),
f AS (SELECT *, (NOT improved AND epoch - coalesce(beb, 0) >= 6 AND coalesce(best_before, '-inf'::DOUBLE) > '-inf'::DOUBLE AND epoch >= 0)
                OR epoch >= 1000000 AS stop_now FROM k2),
g AS (SELECT *, bool_or(stop_now) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped FROM f)
"""


@query("early_stop", f"""
WITH {EARLY_SQL}
SELECT event_id, user_id, step, CAST(epoch AS BIGINT) AS epoch, improved, best, CAST(best_epoch AS BIGINT) AS best_epoch,
       CAST(counter AS BIGINT) AS counter, stop_now, stopped FROM g""")
def q_early_stop(spark, sf):
    t = Tables(spark, sf)
    b = run_bound(t)
    e = SQ.early_stopping(steps(t, b), run_col="user_id", patience=6, largest_group=b)
    return e.select("event_id", "user_id", "step", "epoch", "improved", "best",
                    F.col("best_epoch").cast("bigint").alias("best_epoch"), F.col("counter").cast("bigint").alias("counter"),
                    "stop_now", "stopped")


@query("early_stop_segmented", ORACLES["early_stop"])
def q_early_stop_segmented(spark, sf):
    """The same without a size check: every run in sub-ranges."""
    e = SQ.early_stopping(steps(Tables(spark, sf)), run_col="user_id", patience=6)
    return e.select("event_id", "user_id", "step", "epoch", "improved", "best",
                    F.col("best_epoch").cast("bigint").alias("best_epoch"), F.col("counter").cast("bigint").alias("counter"),
                    "stop_now", "stopped")


_BOARD = """
WITH r AS (SELECT event_type AS prefix, event_type || '|' || CAST(user_id AS VARCHAR) AS description,
                  row_number() OVER (ORDER BY value DESC, event_id) AS place FROM events WHERE value IS NOT NULL)
SELECT prefix, count(*) AS n, min(place) AS best_rank, round(avg(place), 6) AS mean_rank, max(place) AS worst_rank
FROM r {0} GROUP BY prefix"""


def _board(spark, sf, only=None):
    e = Tables(spark, sf).events.select(
        "event_id", "value", F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("description"))
    return SQ.leaderboard(e, "value", "description", "event_id", only=only).withColumn("mean_rank", F.round("mean_rank", 6))


@query("leaderboard", _BOARD.format(""))
def q_leaderboard(spark, sf):
    return _board(spark, sf)


@query("leaderboard_filtered", _BOARD.format("WHERE regexp_matches(description, '[|]1[0-9]*$')"))
def q_leaderboard_filtered(spark, sf):
    """Only descriptions that match; places among all rows."""
    return _board(spark, sf, "[|]1[0-9]*$")
