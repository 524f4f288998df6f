"""Source and sink round trips: each writes a driver table in the format under
test into a fresh folder under the shared checkpoint dir, then reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ordering import md_ratio
from tessera.operators.splits import group_kfold
from tessera.plans import sql as S
from tessera.plans.common import ESSAY_TARGETS, cells_frame, essay_frame, oof_runs, run_predictions
from tessera.plans.registry import query
from tessera.session import scratch_path
from tessera.sources import files
from tessera.sources.tables import Tables


@query("src_essay_csv", f"""
SELECT CAST(doc_id AS VARCHAR) AS text_id, text AS full_text, t_ari, t_wlen, t_loglen
FROM documents JOIN ({S.ESSAY}) e USING (doc_id)""")
def q_src_essay_csv(spark, sf):
    """Essays with multi-line, quoted, comma-laden text through CSV and back."""
    t = Tables(spark, sf)
    e = essay_frame(t).select("doc_id", *ESSAY_TARGETS)
    d = t.documents.join(e, "doc_id").select(F.col("doc_id").cast("string").alias("text_id"),
                                             F.col("text").alias("full_text"), *ESSAY_TARGETS)
    path = scratch_path(spark, "essays_csv")
    files.write_essays(d, path)
    return files.read_essays(spark, path, ESSAY_TARGETS)


@query("src_lenient_tsv", r"""
WITH c AS (SELECT conv_id, turn, role, regexp_replace(text, '[\t\n\r]', ' ', 'g') AS text FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS id, CASE WHEN role = 'system' THEN NULL ELSE text END AS text,
       CASE WHEN role = 'system' THEN NULL ELSE role END AS label
FROM c WHERE turn <> 1""")
def q_src_lenient_tsv(spark, sf):
    """TSV with malformed rows: second turns get an extra field (dropped), system
    turns lose their last two fields (kept, nulls)."""
    c = Tables(spark, sf).conversations.select(
        "conv_id", "turn", "role", F.regexp_replace("text", r"[\t\n\r]", " ").alias("text"))
    line = (F.when(F.col("turn") == 1, F.concat_ws("\t", F.col("conv_id").cast("string"), "text", "role", F.lit("extra")))
            .when(F.col("role") == "system", F.col("conv_id").cast("string"))
            .otherwise(F.concat_ws("\t", F.col("conv_id").cast("string"), "text", "role")))
    path = scratch_path(spark, "lenient_tsv")
    c.select(line.alias("value")).write.mode("overwrite").text(path)
    return files.read_tsv_lenient(spark, path, ["id", "text", "label"])


EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


@query("src_jsonl", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def q_src_jsonl(spark, sf):
    path = scratch_path(spark, "events_jsonl")
    files.write_jsonl(Tables(spark, sf).events, path)
    return files.read_jsonl(spark, path, EVENT_SCHEMA)


@query("src_text_dir", r"""
SELECT CAST(doc_id AS VARCHAR) AS id, trim(regexp_replace(text, '[\t\n\x0B\f\r ]+', ' ', 'g')) AS text FROM documents""")
def q_src_text_dir(spark, sf):
    """One text file per document (id from its folder), whitespace collapsed on read."""
    path = scratch_path(spark, "texts")
    files.write_text_dir(Tables(spark, sf).documents, path, "doc_id")
    return files.read_text_dir(spark, path, id_pattern=r"doc_id=([^/]+)/", id_group=1, name_glob="*.txt")


@query("fold_cache", f"""
WITH r AS ({S.group_folds('documents', 'source')})
SELECT d.doc_id, r.kfold FROM documents d JOIN r USING (source) WHERE r.kfold = 1""")
def q_fold_cache(spark, sf):
    """Folds computed once and stored by fold; reading one fold prunes partitions."""
    d = Tables(spark, sf).documents.select("doc_id", "source")
    path = files.fold_cache_path(scratch_path(spark, "folds"), seed=42, k=5)
    files.fold_cache(group_kfold(d, "source", k=5, seed=42).select("doc_id", "kfold"), path)
    # the second call reuses what the first has written
    cached = files.fold_cache(d.limit(0).select("doc_id", F.lit(0).alias("kfold")), path)
    return cached.where(F.col("kfold") == 1).select("doc_id", "kfold")


@query("submission_join", f"""
WITH {S.RUN_CTES},
a AS (SELECT doc_id, target, avg(pred) AS p FROM fm_lang GROUP BY doc_id, target)
SELECT CAST(d.doc_id AS VARCHAR) AS text_id,
       round(coalesce(max(p) FILTER (WHERE target = 't_ari'), 0.0), 6) AS t_ari,
       round(coalesce(max(p) FILTER (WHERE target = 't_wlen'), 0.0), 6) AS t_wlen,
       round(coalesce(max(p) FILTER (WHERE target = 't_loglen'), 0.0), 6) AS t_loglen
FROM documents d LEFT JOIN a USING (doc_id) GROUP BY d.doc_id""")
def q_submission_join(spark, sf):
    """Fold-averaged test predictions written into the template by id (not by position)."""
    t = Tables(spark, sf)
    tmpl = t.documents.select(F.col("doc_id").cast("string").alias("text_id"),
                              *[F.lit(0.0).alias(c) for c in ESSAY_TARGETS])
    p = run_predictions(t).where(F.col("run") == "lang").groupBy("doc_id", "target").agg(F.avg("pred").alias("p"))
    wide = (p.groupBy(F.col("doc_id").cast("string").alias("text_id")).pivot("target", ESSAY_TARGETS)
            .agg(F.first("p")))
    path = scratch_path(spark, "submission")
    files.write_submission(tmpl, wide, path)
    sch = T.StructType([T.StructField("text_id", T.StringType())] +
                       [T.StructField(c, T.DoubleType()) for c in ESSAY_TARGETS])
    back = spark.read.schema(sch).option("header", True).csv(path)
    return back.select("text_id", *[F.round(c, 6).alias(c) for c in ESSAY_TARGETS])


@query("sink_id_label", "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(quality AS VARCHAR) AS label FROM labels")
def q_sink_id_label(spark, sf):
    lab = Tables(spark, sf).labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    path = scratch_path(spark, "id_label")
    files.write_id_label(lab, path)
    sch = T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType())])
    return spark.read.schema(sch).options(header=True, sep="\t").csv(path)


@query("run_log_union", f"""
WITH {S.OOF_CTES},
per AS (SELECT kfold, target, sqrt(avg((pred - y) * (pred - y))) AS rmse FROM oof WHERE pred IS NOT NULL AND y IS NOT NULL GROUP BY kfold, target),
fs AS (SELECT CAST(kfold AS INTEGER) AS kfold, round(avg(rmse), 4) AS score FROM per GROUP BY kfold)
SELECT 'cv' AS run, round(avg(score), 4) AS score, CAST(count(*) AS INTEGER) AS n_folds, CAST(NULL AS INTEGER) AS best_fold FROM fs
UNION ALL SELECT 'best_fold', min(score), NULL, arg_min(kfold, (score, kfold)) FROM fs""")
def q_run_log_union(spark, sf):
    """Two runs whose log rows have different columns, appended and read back merged."""
    from tessera.operators.metrics import cv_scores
    from tessera.plans.common import essay_oof
    cv = cv_scores(essay_oof(Tables(spark, sf)))
    folds = cv.where(F.col("kfold").isNotNull())
    row1 = folds.agg(F.round(F.avg("score"), 4).alias("score"), F.count(F.lit(1)).cast("int").alias("n_folds")) \
        .select(F.lit("cv").alias("run"), "score", "n_folds")
    row2 = folds.agg(F.min("score").alias("score"), F.min_by("kfold", F.struct("score", "kfold")).alias("best_fold")) \
        .select(F.lit("best_fold").alias("run"), "score", "best_fold")
    path = scratch_path(spark, "run_log")
    files.append_run_log(row1, path)
    log = files.append_run_log(row2, path)
    return log.select("run", "score", "n_folds", "best_fold")


@query("features_json_roundtrip", f"""
WITH cells AS ({S.CELLS}),
f AS (SELECT id, count_if(cell_type <> 'markdown') AS total_code, count_if(cell_type = 'markdown') AS total_md FROM cells GROUP BY id)
SELECT c.id, c.cell_id, f.total_code, f.total_md FROM cells c JOIN f USING (id)""")
def q_features_json_roundtrip(spark, sf):
    """Per-notebook features written as JSON, read back with a schema and attached by id."""
    cells = cells_frame(Tables(spark, sf))
    path = scratch_path(spark, "features_json")
    files.write_features_json(md_ratio(cells, "id").select("id", "total_code", "total_md"), path)
    sch = T.StructType([T.StructField("id", T.LongType()), T.StructField("total_code", T.LongType()),
                        T.StructField("total_md", T.LongType())])
    feats = files.read_features_json(spark, path, sch)
    return cells.select("id", "cell_id").join(feats, "id")


@query("oof_runs_union", f"WITH {S.RUN_CTES} SELECT run, doc_id, target, round(pred, 6) AS pred FROM oof_runs")
def q_oof_runs_union(spark, sf):
    """Each run's OOF table stored separately, then read back as one tagged long table."""
    o = oof_runs(Tables(spark, sf))
    paths = {}
    for run in ("lang", "source", "all"):
        p = scratch_path(spark, f"oof_{run}")
        o.where(F.col("run") == run).drop("run").write.mode("overwrite").parquet(p)
        paths[run] = p
    u = files.read_oof_runs(spark, paths)
    return u.select("run", "doc_id", "target", F.round("pred", 6).alias("pred"))
