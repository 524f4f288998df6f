"""Incremental versions of the batch computations, as Structured Streaming jobs.

Sinks are idempotent: stateful results leave in ``update`` mode through
``foreachBatch``, each micro-batch overwriting its own ``_batch=<id>`` folder (a
retried batch rewrites the same folder); readers keep the latest row per key.
Window state is evicted by the watermark.  Per-run state is a handful of numbers and the
steps that wait for an earlier one; it is kept for the life of the job, as a run may go on
at any time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from tessera.session import materialize, scratch_path
from tessera.sources.files import TS_FORMATS


# ---- inputs: files arriving in chunks ----------------------------------------------------

def write_time_chunks(df: DataFrame, path: str, ts_col: str, n_chunks: int = 4, chunk_rows: int = 500_000) -> int:
    """Simulate arrival: split a table into time ranges of about equal counts, each appended as one
    JSON file in time order (so a file source sees chunks in arrival order); at least
    ``n_chunks``, and as many as keep a file at about ``chunk_rows`` rows.  Returns the number of files.

    The table is worked out once and dealt by time range, so a file reads its own rows only."""
    df = materialize(df, "arrivals")
    ts = F.unix_micros(F.col(ts_col).cast("timestamp"))
    n = df.count()
    if not n:
        return 0
    n_chunks = max(n_chunks, -(-n // chunk_rows))
    shares = [i / n_chunks for i in range(1, n_chunks)]
    cuts = sorted(set(df.agg(F.percentile_approx(ts, shares, 10_000).alias("c")).first()["c"] or []))
    # the number of cuts before a row; rows without a time arrive last
    before = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < ts)) if cuts else F.lit(0)
    dealt = scratch_path(df.sparkSession, "dealt")
    df.withColumn("_chunk", F.when(ts.isNull(), F.lit(len(cuts))).otherwise(before)) \
        .write.partitionBy("_chunk").parquet(dealt)
    dealt = df.sparkSession.read.schema(T.StructType([*df.schema, T.StructField("_chunk", T.IntegerType())])).parquet(dealt)
    for chunk in range(len(cuts) + 1):
        dealt.where(F.col("_chunk") == chunk).select(*df.columns).coalesce(1) \
            .write.mode("append").options(**TS_FORMATS).json(path)
    return len(cuts) + 1


def read_chunks(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).options(**TS_FORMATS)
            .option("maxFilesPerTrigger", files_per_trigger).json(path))


# ---- idempotent update sink ---------------------------------------------------------------

def batch_folder_sink(path: str):
    def write(batch_df: DataFrame, batch_id: int) -> None:
        batch_df.write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")
    return write


def read_latest(spark: SparkSession, path: str, keys) -> DataFrame:
    """Latest row per key over all micro-batch folders."""
    df = spark.read.parquet(path)
    cols = [c for c in df.columns if c != "_batch"]
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in cols if c not in keys]), "_batch").alias("_r"))
    return latest.select(*keys, "_r.*")


def run_available_now(stream_writer, timeout_s: int | None = None):
    """Runs a job until all input is worked off; with ``timeout_s`` it is given up after that time."""
    q = stream_writer.trigger(availableNow=True).start()
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("streaming job did not finish")
    if q.exception() is not None:
        raise q.exception()
    return q


# ---- T1: chunked ingest with a static lookup, partitioned append ------------------------

def ingest(stream: DataFrame, lookup: DataFrame, key: str, lookup_key: str, out_path: str, ckpt: str,
           partition_col: str):
    """Stream-static join against a lookup table, appended to files partitioned by a column."""
    j = stream.join(lookup, stream[key] == lookup[lookup_key], "left").drop(lookup[lookup_key])
    w = (j.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", ckpt)
         .partitionBy(partition_col).outputMode("append"))
    return run_available_now(w)


# ---- T2: five-second windows --------------------------------------------------------------

def window_5s(df: DataFrame, ts_col: str, series_col: str, value_col: str, seconds: int = 5) -> DataFrame:
    """Tumbling windows per series; id ``<series>_<window end, epoch seconds>``.  Values are
    summed in the caller's type (decimals for sums that do not depend on the order)."""
    g = df.groupBy(series_col, F.window(ts_col, f"{seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value_col).alias("_vs"))
    end = F.unix_seconds(F.col("w.end").cast("timestamp"))
    return g.select(F.concat_ws("_", F.col(series_col).cast("string"), end.cast("string")).alias("row_id"),
                    series_col, end.alias("window_end"), "n", F.col("_vs").cast("double").alias("value_sum"))


def stream_window_5s(stream: DataFrame, ts_col: str, series_col: str, value_col: str, out_path: str,
                     ckpt: str, delay: str = "10 seconds"):
    s = stream.withColumn("_ts", F.col(ts_col).cast("timestamp")).withWatermark("_ts", delay)
    agg = window_5s(s, "_ts", series_col, value_col)
    w = (agg.writeStream.outputMode("update").option("checkpointLocation", ckpt)
         .foreachBatch(batch_folder_sink(out_path)))
    return run_available_now(w)


# ---- T2: a fixed grid of windows for every series ------------------------------------------

def _grid_place(ts: Column, start_s: int, seconds: int) -> Column:
    return F.floor((F.unix_micros(ts.cast("timestamp")) - start_s * 1_000_000) / (seconds * 1_000_000)).cast("int")


def fixed_grid(df: DataFrame, ts_col: str, series_col: str, value_col: str, start_s: int, n_windows: int,
               seconds: int = 5) -> DataFrame:
    """Every series on the same ``n_windows`` windows from ``start_s`` (epoch seconds): id
    ``<series>_<seconds from the start to the window's end>``, count and sum.  Empty windows, those behind the
    series' last row too, are padded with zero.  Rows outside of the grid, or without a
    time, only make their series known; a null series is one."""
    place = _grid_place(F.col(ts_col), start_s, seconds)
    place = F.when(place.between(0, n_windows - 1), place)
    sums = df.groupBy(series_col, place.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value_col).alias("s"))
    zero = F.lit(0).cast(sums.schema["s"].dataType)
    # a series is one row of its windows until they are spread out: nothing that is grouped holds the grid
    own = F.collect_list(F.when(F.col("w").isNotNull(), F.struct("w", "n", F.coalesce("s", zero).alias("s"))))
    series = sums.groupBy(series_col).agg(own.alias("_own"))
    empty = F.array_except(F.sequence(F.lit(0), F.lit(n_windows - 1)), F.transform("_own", lambda x: x["w"]))
    padded = F.transform(empty, lambda w: F.struct(w.alias("w"), F.lit(0).cast("long").alias("n"), zero.alias("s")))
    whole = series.select(series_col, F.inline(F.concat("_own", padded)))
    return _grid_rows(whole, series_col, seconds)


def _grid_rows(whole: DataFrame, series_col: str, seconds: int) -> DataFrame:
    end = ((F.col("w") + 1) * seconds).cast("long")
    return whole.select(F.concat_ws("_", F.col(series_col).cast("string"), end.cast("string")).alias("row_id"), series_col,
                        end.alias("window_end"), "n", F.col("s").cast("double").alias("value_sum"), (F.col("n") == 0).alias("padded"))


def heartbeat(spark: SparkSession, path: str, schema, ts_col: str, at_s: int) -> None:
    """A last file with one row that carries nothing but a time: it lets the watermark pass ``at_s``."""
    cols = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != ts_col
            else F.timestamp_seconds(F.lit(at_s)).cast(f.dataType).alias(ts_col) for f in schema.fields]
    spark.range(1).select(*cols).coalesce(1).write.mode("append").options(**TS_FORMATS).json(path)


GRID_STATE = "counts array<long>, sums array<long>, next_window int"
GRID_OUT = "series long, w int, n long, s long"


def _grid_fn(start_s: int, n_windows: int, seconds: int):
    end_ms = [(start_s + (w + 1) * seconds) * 1000 for w in range(n_windows)]

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts, sums, at = state.get if state.exists else ([0] * n_windows, [0] * n_windows, 0)
        counts, sums = np.array(counts, dtype=np.int64), np.array(sums, dtype=np.int64)
        if not state.hasTimedOut:
            for pdf in pdfs:
                w, value = (pdf[c].fillna(none).to_numpy().astype(np.int64) for c, none in (("w", -1), ("value", 0)))
                ok = (w >= at) & (w < n_windows)
                np.add.at(counts, w[ok], 1)
                np.add.at(sums, w[ok], value[ok])
        now = state.getCurrentWatermarkMs()
        first = at
        while at < n_windows and end_ms[at] <= now:
            at += 1
        state.update((counts.tolist(), sums.tolist(), at))
        if at < n_windows:
            state.setTimeoutTimestamp(max(end_ms[at], now + 1))  # wakes when the next window has closed
        if at > first:
            yield pd.DataFrame({"series": key[0], "w": range(first, at), "n": counts[first:at], "s": sums[first:at]})
    return fn


def stream_fixed_grid(stream: DataFrame, ts_col: str, series_col: str, value_col: str, out_path: str, ckpt: str,
                      start_s: int, n_windows: int, seconds: int = 5, delay: str = "10 seconds"):
    """The windows of :func:`fixed_grid` as they close: event-time timers write each window of a
    series, empty ones too, once the watermark has passed its end.  ``value_col`` is a
    whole number.  State is two numbers a window; rows later than ``delay`` are left out."""
    s = (stream.withColumn("_ts", F.col(ts_col).cast("timestamp")).withWatermark("_ts", delay)
         .where(F.col(series_col).isNotNull() | F.col("_ts").isNotNull())
         .select(F.col(series_col).alias("series"), "_ts", F.col(value_col).cast("long").alias("value"),
                 _grid_place(F.col("_ts"), start_s, seconds).alias("w")))
    out = s.groupBy("series").applyInPandasWithState(_grid_fn(start_s, n_windows, seconds), GRID_OUT, GRID_STATE,
                                                     "Update", "EventTimeTimeout")
    w = (out.writeStream.outputMode("update").option("checkpointLocation", ckpt)
         .foreachBatch(batch_folder_sink(out_path)))
    return run_available_now(w)


# ---- T3: running weighted mean per run ---------------------------------------------------

def stream_running_mean(stream: DataFrame, run_col: str, val_col: str, n_col: str, out_path: str, ckpt: str):
    agg = stream.groupBy(run_col).agg(
        F.sum(F.col(val_col) * F.col(n_col)).alias("run_sum"),
        F.sum(n_col).alias("run_count"))
    w = (agg.writeStream.outputMode("update").option("checkpointLocation", ckpt)
         .foreachBatch(batch_folder_sink(out_path)))
    return run_available_now(w)


# ---- T4: early stopping state machine -----------------------------------------------------

STOP_STATE = ("best double, best_epoch long, stopped boolean, stop_step long, next_step long, "
              "steps array<long>, epochs array<long>, scores array<double>")
STOP_OUT = "run long, best double, best_epoch long, stopped boolean, stop_step long"


def _early_stop_fn(patience: int, max_epoch: float, min_epoch: int, at_last_score: float, lateness: int):
    def apply(state, rows):
        """The state after some steps in order."""
        best, best_epoch, stopped, stop_step = state
        for step, epoch, score in rows:
            if stopped:
                break
            improved = score is not None and score == score and (best is None or score > best)
            if improved:
                best, best_epoch = float(score), int(epoch)
            else:
                b = best if best is not None else float("-inf")
                if epoch - best_epoch >= patience and b > at_last_score and epoch >= min_epoch:
                    stopped, stop_step = True, int(step)
            if not stopped and epoch >= max_epoch:
                stopped, stop_step = True, int(step)
        return best, best_epoch, stopped, stop_step

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            *done, next_step, steps, epochs, scores = state.get
            waiting = {s: (s, e, x) for s, e, x in zip(steps, epochs, scores)}
        else:
            done, next_step, waiting = [None, 0, False, None], 0, {}
        done = tuple(done)
        for pdf in pdfs:  # a part of the run's rows at a time
            for s, e, x in zip(pdf["step"], pdf["epoch"], pdf["score"]):
                if not done[2] and s == s and s is not None and s >= next_step:
                    waiting.setdefault(int(s), (int(s), int(e), None if x is None or x != x else float(x)))
            ready = []
            while waiting and (next_step in waiting or max(waiting) - next_step > lateness):
                next_step = min(waiting) if next_step not in waiting else next_step  # a gap is given up
                ready.append(waiting.pop(next_step))
                next_step += 1
            done = apply(done, ready)
            if done[2]:
                waiting = {}  # nothing that comes later counts
        pending = [waiting[s] for s in sorted(waiting)]
        state.update((*done, next_step, [r[0] for r in pending], [r[1] for r in pending], [r[2] for r in pending]))
        best, best_epoch, stopped, stop_step = apply(done, pending)
        yield pd.DataFrame({"run": [key[0]], "best": [best], "best_epoch": [best_epoch], "stopped": [stopped],
                            "stop_step": [stop_step]})
    return fn


def stream_early_stop(stream: DataFrame, run_col: str, out_path: str, ckpt: str, patience: int = 6,
                      max_epoch: float = 1e6, min_epoch: int = 0, at_last_score: float = float("-inf"),
                      lateness: int = 10_000):
    """Per-run best / patience state with ``applyInPandasWithState``.

    Steps are applied in order, in whatever order they arrive: a step waits in the run's state
    until all before it are there, or until the run is ``lateness`` steps further, when the
    gap is given up; a step that arrives after that, or again, is left out, as is a row without a
    step.  What a batch gives is the answer with the waiting steps applied in order, so it is
    that of the rows seen so far.  A state holds ``lateness`` steps at most, and none once the run
    has stopped."""
    s = stream.select(F.col(run_col).alias("run"), "step", "epoch", "score")
    out = s.groupBy("run").applyInPandasWithState(
        _early_stop_fn(patience, max_epoch, min_epoch, at_last_score, lateness), STOP_OUT, STOP_STATE, "Update", "NoTimeout")
    w = (out.writeStream.outputMode("update").option("checkpointLocation", ckpt)
         .foreachBatch(batch_folder_sink(out_path)))
    return run_available_now(w)


def step_log_frame(events: DataFrame, run_col: str = "user_id", per_epoch: int = 3) -> DataFrame:
    """Batch helper: number each run's rows (the step log a trainer writes)."""
    w = Window.partitionBy(run_col).orderBy("ts", "event_id")
    return (events.withColumn("step", F.row_number().over(w) - 1)
            .withColumn("epoch", F.floor(F.col("step") / per_epoch).cast("bigint"))
            .withColumn("score", F.col("value").cast("double")))
