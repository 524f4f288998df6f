"""Streaming plans: each runs a Structured Streaming job to completion
(``availableNow``) over ``events`` arriving as time-ordered chunks, then returns
the sink read back as a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.q_io import EVENT_SCHEMA
from tessera.plans.q_windows import EARLY_SQL, STEPS_SQL, _avg6
from tessera.plans.registry import query
from tessera.session import scratch_path
from tessera.sources.tables import Tables
from tessera.streaming import jobs as J

STEP_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("step", T.LongType()),
    T.StructField("epoch", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("n", T.LongType())])


def _utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")


#: micro-batches of a job: files arrive in time order, each batch takes an equal share of them
BATCHES = 4


def _stream(spark, path, schema, n_files):
    """The chunks in about ``BATCHES`` batches however many there are: a batch costs a round over all
    state and a broadcast of what it is joined with, so their number must not grow with the rows."""
    return J.read_chunks(spark, path, schema, files_per_trigger=max(1, -(-n_files // BATCHES)))


def _event_chunks(spark, sf):
    path = scratch_path(spark, "events_in")
    return path, J.write_time_chunks(Tables(spark, sf).events, path, "ts", n_chunks=BATCHES)


def _step_chunks(spark, sf):
    e = Tables(spark, sf).events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    log = J.step_log_frame(e).select("event_id", "ts", "user_id", "step", "epoch", "score",
                                     (1 + F.col("k") % 4).alias("n"))
    path = scratch_path(spark, "steps_in")
    return path, J.write_time_chunks(log, path, "ts", n_chunks=BATCHES)


@query("stream_ingest", """
SELECT e.event_id, e.user_id, e.event_type, e.value, c.c_mktsegment
FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey""")
def q_stream_ingest(spark, sf):
    """Chunked ingest: file stream, stream-static lookup join, partitioned append."""
    src, n_files = _event_chunks(spark, sf)
    out, ckpt = scratch_path(spark, "ingest_out"), scratch_path(spark, "ingest_ckpt")
    lookup = Tables(spark, sf).customer.select("c_custkey", "c_mktsegment")
    stream = _stream(spark, src, EVENT_SCHEMA, n_files).select("event_id", "user_id", "event_type", "value")
    J.ingest(stream, lookup, "user_id", "c_custkey", out, ckpt, "c_mktsegment")
    return spark.read.parquet(out).select("event_id", "user_id", "event_type", "value", "c_mktsegment")


# values of more than two decimals
_THIRD = "CAST(value AS decimal(18,2)) * CAST('0.123' AS decimal(4,3))"
_WIN_SQL = """
SELECT CAST(user_id AS VARCHAR) || '_' || CAST(e AS VARCHAR) AS row_id, user_id, e AS window_end, count(*) AS n,
       CAST(sum(CAST(value AS DECIMAL(18,2)) * 0.123) AS DOUBLE) AS value_sum
FROM (SELECT *, CAST((epoch_us(ts) // 5000000 + 1) * 5 AS BIGINT) AS e FROM events) GROUP BY user_id, e"""


@query("tumbling_5s", _WIN_SQL)
def q_tumbling_5s(spark, sf):
    _utc(spark)
    return J.window_5s(Tables(spark, sf).events.withColumn("value", F.expr(_THIRD)), "ts", "user_id", "value")


@query("stream_tumbling_5s", _WIN_SQL)
def q_stream_tumbling_5s(spark, sf):
    """Five-second windows with a watermark, update mode into an idempotent sink."""
    _utc(spark)
    src, n_files = _event_chunks(spark, sf)
    out, ckpt = scratch_path(spark, "win_out"), scratch_path(spark, "win_ckpt")
    J.stream_window_5s(_stream(spark, src, EVENT_SCHEMA, n_files).withColumn("value", F.expr(_THIRD)), "ts", "user_id", "value", out, ckpt)
    return J.read_latest(spark, out, ["row_id"]).select("row_id", "user_id", "window_end", "n", "value_sum")


@query("stream_running_mean", f"""
WITH {STEPS_SQL},
c AS (SELECT user_id, CAST(CAST(score AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents, 1 + k % 4 AS n FROM e),
r AS (SELECT user_id, sum(cents * n) AS sc, sum(n) AS run_count FROM c GROUP BY user_id)
SELECT user_id, CAST(sc AS DOUBLE) / 100 AS run_sum, CAST(run_count AS BIGINT) AS run_count, {_avg6('sc', 'run_count')} AS run_avg FROM r""")
def q_stream_running_mean(spark, sf):
    src, n_files = _step_chunks(spark, sf)
    out, ckpt = scratch_path(spark, "rm_out"), scratch_path(spark, "rm_ckpt")
    log = _stream(spark, src, STEP_SCHEMA, n_files).withColumn("score", F.col("score").cast("decimal(18,2)"))
    J.stream_running_mean(log, "user_id", "score", "n", out, ckpt)
    r = J.read_latest(spark, out, ["user_id"])
    return r.select("user_id", F.col("run_sum").cast("double").alias("run_sum"),
                    F.col("run_count").cast("bigint").alias("run_count"),
                    F.round(F.col("run_sum") / F.col("run_count"), 6).cast("double").alias("run_avg"))


@query("stream_early_stop", f"""
WITH {EARLY_SQL},
fs AS (SELECT user_id, min(step) FILTER (WHERE stop_now) AS stop_step, max(step) AS last_step FROM g GROUP BY user_id)
SELECT g.user_id AS run, g.best, CAST(g.best_epoch AS BIGINT) AS best_epoch, fs.stop_step IS NOT NULL AS stopped,
       CAST(fs.stop_step AS BIGINT) AS stop_step
FROM g JOIN fs ON g.user_id = fs.user_id AND g.step = coalesce(fs.stop_step, fs.last_step)""")
def q_stream_early_stop(spark, sf):
    """Per-run patience state machine (applyInPandasWithState) over streamed step logs."""
    src, n_files = _step_chunks(spark, sf)
    out, ckpt = scratch_path(spark, "es_out"), scratch_path(spark, "es_ckpt")
    J.stream_early_stop(_stream(spark, src, STEP_SCHEMA, n_files), "user_id", out, ckpt, patience=6)
    return J.read_latest(spark, out, ["run"]).select("run", "best", "best_epoch", "stopped", "stop_step")


# 124 windows of six hours from 2024-01-01, for every user; values in thousandths
GRID = dict(start_s=1704067200, n_windows=124, seconds=21600)
_MILLS = "CAST(round(CAST(value AS decimal(18,2)) * 1000) AS BIGINT)"
_GRID_SQL = f"""
WITH e AS (SELECT user_id, CAST(floor((epoch_us(ts) - {GRID['start_s'] * 1000000}) / CAST({GRID['seconds'] * 1000000} AS DOUBLE)) AS INT) AS w,
                  {_MILLS} AS v FROM events),
g AS (SELECT user_id, unnest(range({GRID['n_windows']})) AS w FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)),
a AS (SELECT user_id, w, count(*) AS n, sum(v) AS s FROM e GROUP BY ALL)
SELECT concat_ws('_', CAST(g.user_id AS VARCHAR), CAST((g.w + 1) * {GRID['seconds']} AS VARCHAR)) AS row_id, g.user_id,
       CAST((g.w + 1) * {GRID['seconds']} AS BIGINT) AS window_end, coalesce(a.n, 0) AS n,
       CAST(coalesce(a.s, 0) AS DOUBLE) AS value_sum, coalesce(a.n, 0) = 0 AS padded
FROM g LEFT JOIN a ON a.user_id = g.user_id AND a.w = g.w"""


@query("fixed_grid", _GRID_SQL)
def q_fixed_grid(spark, sf):
    """Every user on one grid of windows; empty ones and the tail padded with zero."""
    _utc(spark)
    e = Tables(spark, sf).events.where("user_id IS NOT NULL").withColumn("value", F.expr(_MILLS))
    return J.fixed_grid(e, "ts", "user_id", "value", **GRID)


@query("stream_fixed_grid", _GRID_SQL)
def q_stream_fixed_grid(spark, sf):
    """The same windows from event-time timers as the watermark passes them; a last row without a user
    carries the time on to the grid's end."""
    _utc(spark)
    src, n_files = _event_chunks(spark, sf)
    J.heartbeat(spark, src, EVENT_SCHEMA, "ts", GRID["start_s"] + (GRID["n_windows"] + 1) * GRID["seconds"])
    out, ckpt = scratch_path(spark, "grid_out"), scratch_path(spark, "grid_ckpt")
    stream = _stream(spark, src, EVENT_SCHEMA, n_files).withColumn("value", F.expr(_MILLS))
    J.stream_fixed_grid(stream, "ts", "user_id", "value", out, ckpt, **GRID)
    rows = J.read_latest(spark, out, ["series", "w"]).where("series IS NOT NULL").withColumnRenamed("series", "user_id")
    return J._grid_rows(rows, "user_id", GRID["seconds"])
