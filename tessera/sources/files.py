"""Readers and writers for the input and output formats of the scoring workflow.

Every reader declares its schema (no inference passes over 100 TB), every
writer is a distributed Spark write; nothing is staged through the driver.
"""

from __future__ import annotations

import os
import re
import unicodedata
from fnmatch import fnmatchcase
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ESSAY_TARGETS = ["cohesion", "syntax", "vocabulary", "phraseology", "grammar", "conventions"]

NOTEBOOK_DOC = "struct<cell_type: map<string,string>, source: map<string,string>>"


# ---- essays: quoted CSV with embedded newlines and commas ---------------------------------

def essay_schema(targets=()) -> T.StructType:
    fields = [T.StructField("text_id", T.StringType()), T.StructField("full_text", T.StringType())]
    fields += [T.StructField(t, T.DoubleType()) for t in targets]
    return T.StructType(fields)


def read_essays(spark: SparkSession, path: str, targets=()) -> DataFrame:
    """CSV with quoted multi-line text (RFC 4180 doubled quotes)."""
    return (spark.read.schema(essay_schema(targets))
            .options(header=True, multiLine=True, quote='"', escape='"')
            .csv(path))


def write_essays(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite")
     .options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path))


# ---- lenient TSV ------------------------------------------------------------------------

def read_tsv_lenient(spark: SparkSession, path: str, columns, sep: str = "\t") -> DataFrame:
    """Tab-separated rows: rows with *more* fields than columns are dropped, short rows
    are kept with nulls (what a lenient pandas read does).

    Read as plain lines, so the field count of the raw line decides.  Of a file that has lines
    equal to the header one is dropped, so data rows that equal it stay.
    """
    cols = list(columns)
    lines = spark.read.text(path)
    parts = F.split(F.col("value"), sep, -1)
    fields = [F.try_element_at(parts, F.lit(i + 1)).alias(c) for i, c in enumerate(cols)]
    header = F.col("value") == sep.join(cols)
    rows = lines.where(~header & (F.size(parts) <= len(cols))).select(*fields)
    # equal lines are interchangeable: all but one of each file are data
    again = (lines.where(header).groupBy(F.col("value"), F.input_file_name().alias("_file")).agg(F.count(F.lit(1)).alias("_n"))
             .where("_n > 1").withColumn("_again", F.explode(F.sequence(F.lit(2), F.col("_n")))).select(*fields))
    return rows.unionByName(again)


def write_tsv(df: DataFrame, path: str, header: bool = True, sep: str = "\t") -> None:
    df.write.mode("overwrite").options(header=header, sep=sep, quote="", escape="").csv(path)


# ---- JSON lines -------------------------------------------------------------------------

TS_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
              "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines with a declared schema; timestamps keep microseconds."""
    return spark.read.schema(schema).options(**TS_FORMATS).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**TS_FORMATS).json(path)


# ---- notebook JSON documents, one per id ------------------------------------------------

def write_notebook_docs(cells: DataFrame, path: str, id_col="id", item_col="cell_id",
                        type_col="cell_type", source_col="source") -> None:
    """One JSON document per id: ``{cell_type: {cell: type}, source: {cell: text}}``."""
    docs = cells.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct(item_col, type_col))).alias("cell_type"),
        F.map_from_entries(F.collect_list(F.struct(item_col, source_col))).alias("source"))
    docs.write.mode("overwrite").partitionBy(id_col).json(path)


def read_notebook_dir(spark: SparkSession, glob: str, id_pattern: str = r"([^/=]+)=([^/]+)/[^/]+$",
                      id_group: int = 2, id_type: str = "bigint") -> DataFrame:
    """Cells of every notebook document under ``glob``.

    The notebook id comes from the file path (``id_pattern``; use ``([^/]+)\\.json$``
    with group 1 for ``<id>.json`` files).  ``cell_pos`` is the cell's position
    inside the document.
    """
    raw = spark.read.text(glob, wholetext=True).select("value", F.col("_metadata.file_path").alias("_path"))
    docs = raw.select(F.regexp_extract("_path", id_pattern, id_group).cast(id_type).alias("id"),
                      F.from_json("value", NOTEBOOK_DOC).alias("d"))
    cells = docs.select("id", "d.source", F.posexplode(F.map_entries("d.cell_type")).alias("cell_pos", "e"))
    return cells.select("id", F.col("e.key").alias("cell_id"), F.col("e.value").alias("cell_type"),
                        F.element_at("source", F.col("e.key")).alias("source"), "cell_pos")


# ---- text files, one per id -------------------------------------------------------------

def _folder_name(value) -> str:
    """An id as Spark names its folder."""
    text = "" if value is None else str(value)
    return re.sub(r"[\x00-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda m: f"%{ord(m[0]):02X}", text) or "__HIVE_DEFAULT_PARTITION__"


def _mounted(path: str) -> str | None:
    """The folder of a ``file:`` path, which tasks open by themselves."""
    scheme, _, rest = path.rpartition(":")
    return "/" + rest.lstrip("/") if scheme == "file" else None


def write_text_dir(df: DataFrame, path: str, id_col: str = "id", text_col: str = "text") -> None:
    """One folder ``<id_col>=<id>`` an id; a task writes its texts of an id, a line end behind each, as one file.

    On a mounted folder that all machines share, the tasks make the files themselves (Hadoop's local
    file system starts processes for the rights of every file and folder); a repeated task
    replaces its files whole.  Elsewhere Spark's writer does it, whose tasks put their files in
    place when they commit: by default the driver alone moves all folders, one by one."""
    d = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    base = _mounted(path)
    if not base:
        (d.select(F.col("id").alias(id_col), F.col("text").alias("value")).write.mode("overwrite")
         .option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(id_col).text(path))
        return

    def put(at: str, name: str, lines: list[str]) -> None:
        folder = f"{base}/{id_col}={_folder_name(at)}"
        os.makedirs(folder, exist_ok=True)
        part = f"{folder}/.{name}-{TaskContext.get().taskAttemptId()}"
        with open(part, "w", encoding="utf-8", newline="") as f:
            f.writelines(x + "\n" for x in lines)
        os.replace(part, f"{folder}/{name}.txt")

    def run(batches):
        name, n, last, lines = f"part-{TaskContext.get().partitionId():05d}", 0, None, []
        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lines and at != last:
                    put(last, name, lines)
                    lines = []
                last = at
                lines.append(text or "")
                n += 1
        if lines:
            put(last, name, lines)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    os.makedirs(base, exist_ok=True)
    d.sortWithinPartitions("id").mapInArrow(run, "n long").agg(F.sum("n")).collect()


#: file names that tasks can match and read as Spark does: no other wildcards, nothing compressed
_PLAIN_NAMES = re.compile(r"[\w*?.-]*\.txt", re.ASCII)
#: rows and bytes of texts that a task hands on at once
_BATCH_ROWS, _BATCH_BYTES = 512, 4 << 20


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _as_uri(path: str) -> str:
    """A path as Spark's file metadata has it: spaces, controls and ASCII without a place in URIs as %XX."""
    def quoted(m):
        c = m[0]
        return c if c > "\x7f" and unicodedata.category(c) not in ("Cc", "Zs", "Zl", "Zp") else "".join(f"%{x:02X}" for x in os.fsencode(c))
    return "file://" + re.sub(r"[^A-Za-z0-9_\-!.~'()*,;:$&+=@/]", quoted, path)


def _read_mounted(spark: SparkSession, base: str, name_glob: str) -> DataFrame:
    """(value, _path) of the files of these names below a mounted folder, empty ones left out.

    One task names the entries of the folder, a batch at a time, and the tasks they are dealt to
    list and read what is below: no process holds a list of the files."""
    def entries(_):
        with os.scandir(base) as found:
            names = []
            for e in found:
                if not _hidden(e.name):
                    names.append(os.fsencode(e.name))
                if len(names) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary())], names=["name"])
                    names = []
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary())], names=["name"])

    def below(path: str):
        if not os.path.isdir(path):
            if fnmatchcase(os.path.basename(path), name_glob) and os.path.getsize(path):
                yield path
            return
        with os.scandir(path) as found:
            for e in found:
                if not _hidden(e.name):
                    yield from below(e.path)

    def rows(texts, paths):
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(paths, pa.binary())], names=["value", "_path"])

    def read(batches):
        texts, paths, size = [], [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                for path in below(os.path.join(base, os.fsdecode(name))):
                    with open(path, "rb") as f:
                        texts.append(f.read())
                    paths.append(os.fsencode(_as_uri(path)))
                    size += len(texts[-1])
                    if size >= _BATCH_BYTES or len(texts) >= _BATCH_ROWS:
                        yield rows(texts, paths)
                        texts, paths, size = [], [], 0
        yield rows(texts, paths)

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = spark.range(0, 1, 1, 1).mapInArrow(entries, "name binary").repartition(tasks, "name")
    return names.mapInArrow(read, "value binary, _path binary").select(F.col("value").cast("string"), F.col("_path").cast("string"))


def read_text_dir(spark: SparkSession, glob: str, id_pattern: str = r"([^/]+)\.[^./]+$",
                  id_group: int = 1, name_glob: str | None = None) -> DataFrame:
    """(id, text) per whole file; id = file name without extension; whitespace collapsed.

    ``glob`` is expanded by the driver, a folder after the other.  With ``name_glob`` it is a
    folder instead: the files of these names anywhere below it.  On a mounted folder the tasks list
    and read them; elsewhere a Spark job lists them for the driver, whose memory bounds their number."""
    base = _mounted(glob)
    if base and name_glob and _PLAIN_NAMES.fullmatch(name_glob) and os.path.isdir(base):
        raw = _read_mounted(spark, base, name_glob)
    else:
        below = {"recursiveFileLookup": True, "pathGlobFilter": name_glob} if name_glob else {}
        raw = (spark.read.options(**below).text(glob, wholetext=True)
               .select("value", F.col("_metadata.file_path").alias("_path")))
    return raw.select(F.regexp_extract("_path", id_pattern, id_group).alias("id"),
                      F.trim(F.regexp_replace("value", r"\s+", " ")).alias("text"))


# ---- ragged group rows: gid, fid, fid, ... ----------------------------------------------

def read_ragged_groups(spark: SparkSession, path: str) -> DataFrame:
    """Variable-width CSV rows ``gid,f1,f2,...`` -> (gid, fid)."""
    parts = F.split(F.trim(F.col("value")), ",", -1)
    rows = spark.read.text(path).where(F.trim("value") != "")
    # the line is split once a group, below the explode, and not again for each member
    groups = rows.select(F.try_element_at(parts, F.lit(1)).cast("bigint").alias("gid"),
                         F.slice(parts, 2, F.size(parts) - 1).alias("fids"))
    return groups.select("gid", F.explode("fids").alias("fid")) \
        .select("gid", F.trim("fid").cast("bigint").alias("fid"))


def write_ragged_groups(pairs: DataFrame, path: str, gid="gid", fid="fid") -> None:
    """(gid, fid) -> one text line per group.  Each line is one group's member list,
    the format itself; the members are sorted for a stable layout."""
    lines = pairs.groupBy(gid).agg(F.sort_array(F.collect_list(F.col(fid).cast("string"))).alias("_m"))
    lines.select(F.concat_ws(",", F.col(gid).cast("string"), F.array_join("_m", ",")).alias("value")) \
        .write.mode("overwrite").text(path)


# ---- partitioned / cached tables --------------------------------------------------------

def write_by_group(df: DataFrame, path: str, group_col: str, n_buckets: int = 64,
                   bucket_col: str = "group_bucket", mode: str = "append", file_rows: int = 1_000_000) -> None:
    """Append rows grouped by ``group_col`` hash buckets: a bounded number of
    directories however many groups exist; each bucket holds whole groups.

    A count first tells each bucket's size; its rows are dealt by a hash of the whole row
    over as many writers as keep a file at about ``file_rows`` rows, so a hot group has
    several files and no writer has a bucket to itself that grows with the data."""
    out = df.withColumn(bucket_col, F.pmod(F.xxhash64(F.col(group_col)), F.lit(n_buckets)).cast("int"))
    sizes = {r[bucket_col]: r["n"] for r in out.groupBy(bucket_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        out.write.mode(mode).partitionBy(bucket_col).parquet(path)
        return
    parts = {b: -(-n // file_rows) for b, n in sizes.items()}  # a row a bucket
    salts = F.create_map(*[F.lit(v) for b in sorted(parts) for v in (b, parts[b])])
    row = F.xxhash64(*[F.col(c) for c in df.columns], F.spark_partition_id())
    salt = F.pmod(row, F.element_at(salts, F.col(bucket_col)).cast("long"))
    (out.withColumn("_salt", salt).repartition(sum(parts.values()), bucket_col, "_salt").drop("_salt")
     .write.mode(mode).partitionBy(bucket_col).parquet(path))


def read_group(spark: SparkSession, path: str, group_col: str, value, n_buckets: int = 64,
               bucket_col: str = "group_bucket") -> DataFrame:
    """Read one group back: the bucket filter prunes to one directory."""
    b = spark.range(1).select(F.pmod(F.xxhash64(F.lit(value)), F.lit(n_buckets)).cast("int")).first()[0]
    return spark.read.parquet(path).where((F.col(bucket_col) == b) & (F.col(group_col) == value))


def fold_cache(df: DataFrame, path: str, fold_col: str = "kfold") -> DataFrame:
    """Materialize a fold table once, partitioned by fold; later reads prune by fold.

    Only a table whose write was finished (``_SUCCESS``) is reused; errors of reading one
    are the caller's.  Folds of another seed or count belong in another path
    (``fold_cache_path``)."""
    spark = df.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").partitionBy(fold_col).parquet(path)
    return spark.read.parquet(path)


def fold_cache_path(base: str, seed: int, k: int) -> str:
    return f"{base.rstrip('/')}/seed={seed}/k={k}"


# ---- submissions, labels, run logs, features --------------------------------------------

def write_submission(template: DataFrame, preds: DataFrame, path: str, id_col: str = "text_id") -> DataFrame:
    """Template columns overwritten by predictions joined on id (never by position)."""
    cols = template.columns
    over = [c for c in cols if c != id_col and c in preds.columns]
    out = template.alias("t").join(preds.select(id_col, *over).alias("p"), id_col, "left").select(
        *[(F.coalesce(F.col(f"p.{c}"), F.col(f"t.{c}")).alias(c) if c in over else F.col(f"t.{c}") if c != id_col
           else F.col(id_col)) for c in cols])
    out.write.mode("overwrite").option("header", True).csv(path)
    return out


def write_id_label(df: DataFrame, path: str, id_col: str = "id", label_col: str = "label") -> None:
    df.select(id_col, label_col).write.mode("overwrite").options(header=True, sep="\t").csv(path)


def union_run_logs(frames) -> DataFrame:
    """Rows of run logs whose columns differ: union by name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def append_run_log(row: DataFrame, path: str) -> DataFrame:
    """Append one run's row; the log is read back with merged schemas."""
    row.write.mode("append").parquet(path)
    return row.sparkSession.read.option("mergeSchema", True).parquet(path)


def write_features_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_features_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_oof_runs(spark: SparkSession, paths: dict) -> DataFrame:
    """N prediction tables tagged by run name, in long form."""
    frames = [spark.read.parquet(p).withColumn("run", F.lit(name)) for name, p in paths.items()]
    return union_run_logs(frames)
