"""Streams fed out of order, fixed grids, and null keys of ordered operators."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ordering, sequences
from tessera.session import scratch_path
from tessera.sources.files import TS_FORMATS
from tessera.streaming import jobs as J

SCHEMA = "user_id long, step long, epoch long, score double"


def stop_of(scores, patience):
    best, at, stop = None, 0, None
    for step, score in enumerate(scores):
        epoch = step // 3
        if best is None or score > best:
            best, at = score, epoch
        elif epoch - at >= patience:
            stop = step
            break
    return best, at, stop is not None, stop


@pytest.mark.parametrize("lateness", [10_000, 40])
def test_late_files_give_the_batch_answer(spark, lateness):
    rng = random.Random(4)
    runs = {u: [round(rng.random() + s / 60 * (u % 2), 3) for s in range(60)] for u in range(4)}
    rows = [(u, s, s // 3, x) for u, xs in runs.items() for s, x in enumerate(xs)]
    late = [r for r in rows if r[1] in (0, 7) or (r[0] == 1 and 20 <= r[1] < 30)]  # as rows without a time do
    rest = [r for r in rows if r not in late]
    rng.shuffle(rest)
    path = scratch_path(spark, "late")
    for part in (rest[:30], rest[30:], rest[:5], [(2, None, None, 9.0)], late):  # some rows twice, one without a step
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(path)
    out, ckpt = scratch_path(spark, "out"), scratch_path(spark, "ckpt")
    J.stream_early_stop(J.read_chunks(spark, path, SCHEMA), "user_id", out, ckpt, patience=6, lateness=lateness)
    got = {r["run"]: (r["best"], r["best_epoch"], r["stopped"], r["stop_step"]) for r in J.read_latest(spark, out, ["run"]).collect()}
    if lateness > 60:
        assert got == {u: stop_of(xs, 6) for u, xs in runs.items()}
    else:  # gaps older than that are given up: every run still has an answer
        assert got.keys() == runs.keys()


EVENTS = "k long, ts timestamp, value long"


@pytest.fixture
def events(spark):
    rng = random.Random(5)
    rows = [(u, 1000 + rng.randrange(0, 70), rng.randrange(100)) for u in (1, 2, 3) for _ in range(12)]
    rows += [(4, 990, 5), (4, 5000, 6), (5, 1003, 7), (5, None, 8)]  # outside of the grid, and without a time
    return rows, spark.createDataFrame(rows, "k long, s long, value long").select(
        "k", F.timestamp_seconds("s").alias("ts"), "value")


def plain_grid(rows, n, seconds):
    out = {(u, w): [0, 0] for u in {r[0] for r in rows} for w in range(n)}
    for u, s, v in rows:
        if s is not None and 0 <= (s - 1000) // seconds < n:
            out[u, (s - 1000) // seconds][0] += 1
            out[u, (s - 1000) // seconds][1] += v
    return {(u, (w + 1) * seconds): (c, float(v), c == 0) for (u, w), (c, v) in out.items()}


def by_window(df):
    got = {(r["k"], r["window_end"]): (r["n"], r["value_sum"], r["padded"]) for r in df.collect()}
    return got


def test_fixed_grid_pads_every_series(spark, events):
    rows, df = events
    assert by_window(J.fixed_grid(df, "ts", "k", "value", 1000, 16)) == plain_grid(rows, 16, 5)
    odd = df.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, timestamp_seconds(1001) AS ts, 3L AS value"))
    got = by_window(J.fixed_grid(odd, "ts", "k", "value", 1000, 16))
    assert got[None, 5] == (1, 3.0, False) and got[None, 10] == (0, 0.0, True)
    assert J.fixed_grid(df.where("k > 9"), "ts", "k", "value", 1000, 16).collect() == []


def test_streamed_grid_equals_the_batch_one(spark, events):
    rows, df = events
    path = scratch_path(spark, "grid")
    df = df.where("k < 4")
    J.write_time_chunks(df, path, "ts", n_chunks=5)
    J.heartbeat(spark, path, df.schema, "ts", 1000 + 18 * 5 + 20)
    out, ckpt = scratch_path(spark, "out"), scratch_path(spark, "ckpt")
    J.stream_fixed_grid(J.read_chunks(spark, path, EVENTS), "ts", "k", "value", out, ckpt, 1000, 16)
    found = J.read_latest(spark, out, ["series", "w"]).where("series IS NOT NULL").withColumnRenamed("series", "k")
    assert by_window(J._grid_rows(found, "k", 5)) == plain_grid([r for r in rows if r[0] < 4], 16, 5)


def test_chunks_keep_every_row_in_time_order(spark, tmp_path):
    rows = [(i, None if i % 10 == 0 else i // 4) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    path = str(tmp_path / "chunks")
    J.write_time_chunks(df, path, "ts", n_chunks=2, chunk_rows=30)
    back = spark.read.schema("id long, ts timestamp").options(**TS_FORMATS).json(path).withColumn("f", F.input_file_name())
    files = back.groupBy("f").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).orderBy("a").collect()
    assert back.count() == 200 and len(files) >= 6 and max(f["n"] for f in files) <= 60
    assert all(x["b"] < y["a"] for x, y in zip(files, files[1:]))


def test_moving_mean_of_rows_without_a_run(spark):
    df = spark.createDataFrame([(None, i, float(i)) for i in range(6)] + [(1, i, 2.0) for i in range(3)], "run long, i long, v double")
    for largest in (None, 10):
        got = sequences.moving_mean(df, "run", "i", "v", width=2, largest_group=largest).collect()
        assert len(got) == 9
        assert [r["moving_avg"] for r in sorted(got, key=lambda r: r["i"]) if r["run"] is None] == [0, .5, 1.5, 2.5, 3.5, 4.5]


def test_order_masks_of_cells_without_an_id(spark):
    rows = [(u, f"c{i}", i, "markdown" if i % 2 else "code") for u in (None, "a") for i in range(7)]
    got = {r["id"]: r for r in ordering.order_masks(spark.createDataFrame(rows, "id string, cell_id string, rank int, cell_type string")).collect()}
    assert sorted(got[None]["permutation"]) == sorted(got["a"]["permutation"]) == [0, 1, 2]
    assert got[None]["cell_shuffle"] == got["a"]["cell_shuffle"]


def test_the_feeder_works_its_rows_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def note(x):
        seen.add(1)
        return x
    df = spark.range(200).select(F.udf(note, "long")("id").alias("id"), F.timestamp_seconds("id").alias("ts"))
    assert J.write_time_chunks(df, str(tmp_path / "once"), "ts", n_chunks=8) == 8
    assert seen.value == 200


def test_batches_do_not_grow_with_the_files(spark):
    from tessera.plans.q_stream import BATCHES, _stream
    path, out, ckpt = (scratch_path(spark, x) for x in ("many", "out", "ckpt"))
    df = spark.range(200).selectExpr("id % 3 AS k", "timestamp_seconds(id) AS ts", "id AS value", "1 AS n")
    n_files = J.write_time_chunks(df, path, "ts", chunk_rows=10)
    J.stream_running_mean(_stream(spark, path, df.schema, n_files), "k", "value", "n", out, ckpt)
    assert n_files > 3 * BATCHES and spark.read.parquet(out).select("_batch").distinct().count() <= BATCHES
    got = {r["k"]: r["run_sum"] for r in J.read_latest(spark, out, ["k"]).collect()}
    assert got == {k: sum(range(k, 200, 3)) for k in range(3)}


def test_no_aggregate_holds_the_whole_grid(spark, events):
    plan = J.fixed_grid(events[1], "ts", "k", "value", 1000, 16)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")
