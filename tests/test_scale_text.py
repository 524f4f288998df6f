"""Text steps whose cost follows the documents: cleaning, first words, encoding, masks, text folders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import text as X
from tessera.operators import vocab as V

TEXTS = ["", " ", "a", " a ", " a b ", "a b c d", " a b c d e", "__a__", "x_y  z", "\"A dog's b-c_d, é f g", "B", " .b", ".b c",
         " a  1 2 b 3", "ΑΣ b ΑΣ", "1 a 2", "ü a ö b", "-- a", "a -", "É è x y z w", "İ a b", "a\tb\rc d", "😀 a 😀 b cd", None]


def _four_steps(c):
    t = F.regexp_replace(F.col(c), r"[^\p{L}\p{N}_]", " ")
    t = F.regexp_replace(t, "_", " ")
    t = F.regexp_replace(t, " +[a-zA-Z] +", " ")
    return F.lower(F.regexp_replace(t, " +", " "))


def test_cleaning_and_first_word_as_step_by_step(spark):
    rng = np.random.default_rng(3)
    texts = TEXTS + ["".join(rng.choice(list(" _.aBé1x\t"), rng.integers(1, 25))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    words = F.filter(F.split(_four_steps("t"), " ", -1), lambda x: x != "")
    rows = df.select("t", _four_steps("t").alias("old"), X.clean_text("t").alias("new"), words.alias("words"),
                     X.clean_words("t").alias("got"), X.first_clean_word("t").alias("first")).collect()
    for r in rows:
        assert r.old == r.new and r.words == r.got, repr(r.t)
        assert (r.words[0] if r.words else "") == (r["first"] or ""), repr(r.t)


def test_encode_looks_arrays_up_and_equals_the_join(spark):
    vocab = spark.createDataFrame([(w, 1000 + i) for i, w in enumerate(["a", "b", "é", "[SEP]"])], "token string, id int")
    rows = [(1, ["a", "x", "b"]), (1, ["b"]), (2, []), (3, None), (None, ["é", None, "[CLS]"]), (None, ["[SEP]", "a"]), (4, ["a"] * 300)]
    df = spark.createDataFrame(rows, "k long, tokens array<string>")
    for specials in (None, {"[CLS]": 101, "[SEP]": 102}):
        one = V.encode(df, "k", "tokens", vocab, specials=specials)
        assert "Generate" not in one._jdf.queryExecution().executedPlan().toString()  # no row a token
        joined = V.encode(df, "k", "tokens", vocab, specials=specials, task_words=3)
        assert one.schema.simpleString() == joined.schema.simpleString()
        assert dict(one.collect()) == dict(joined.collect())
    none = vocab.where("id < 0")
    assert dict(V.encode(df, "k", "tokens", none).collect())[1] == [100] * 4


def test_ngram_masks_as_drawn_by_choice():
    """The draws of ``rng.choice`` with chances, one by one."""
    for seed in range(40):
        ids = np.random.default_rng(seed).integers(1000, 3000, seed * 3)
        rng, most = np.random.default_rng(seed), max(1, int(round(0.15 * len(ids))))
        out, labels, covered = ids.copy(), np.full(len(ids), A.IGNORE_LABEL), set()
        for s in rng.permutation(np.arange(len(ids))) if len(ids) else ():
            if len(covered) >= most:
                break
            if s in covered:
                continue
            n = int(rng.choice([1, 2, 3], p=np.array([6, 3, 2]) / 11))
            for j in range(s, min(s + n, len(ids))):
                if j not in covered:
                    covered.add(j)
                    labels[j], r = ids[j], rng.random()
                    out[j] = A.MASK_ID if r < 0.8 else out[j] if r < 0.9 else int(rng.integers(1000, 4000))
        got = A._mask_ngrams_row(ids, seed, 4000)
        assert got[0].tolist() == out.tolist() and got[1].tolist() == labels.tolist()


def test_keyed_masks_hash_a_place_once(spark):
    df = spark.createDataFrame([(1, [101, 1500, 1600, 102])], "id long, ids array<int>")
    plan = df.select(A.mask_ngrams_keyed("ids", "id", 1900).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") <= 2  # for the draws, and for covered places; before: once a use


def test_text_dir_written_by_the_tasks(spark, tmp_path):
    from tessera.sources import files
    rows = [(1, "a\n b"), (2, None), (None, "x"), (3, ""), (1, "c"), (-4, "é 😀\r\n\tz ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for path in (f"file:{tmp_path}/own", f"{tmp_path}/spark"):  # by the tasks, by Spark's writer
        files.write_text_dir(df, path, "doc_id")
        got = files.read_text_dir(spark, path, id_pattern=r"doc_id=([^/]+)/", name_glob="*.txt")
        got = {r["id"]: r["text"] for r in got.collect()}
        assert got.pop("1") in ("a b c", "c a b")
        assert got == {"2": "", "__HIVE_DEFAULT_PARTITION__": "x", "3": "", "-4": "é 😀 z"}
    odd = spark.createDataFrame([("a/b%:é", "t"), ("..", "u")], "id string, text string")
    files.write_text_dir(odd, f"file:{tmp_path}/odd")
    assert sorted(p.name for p in (tmp_path / "odd").iterdir()) == ["id=..", "id=a%2Fb%25%3Aé"]


def test_text_dir_read_by_the_tasks(spark, tmp_path):
    """No process lists the files of a mounted folder: few tasks, no file index; the rows are those of Spark's reader."""
    from tessera.sources import files
    rows = [(str(i), f" text\n {i} ") for i in range(300)] + [("a/b%:é", "t"), ("..", "u"), ("x y", "\u00a0v\u3000 w"), (None, "z")]
    files.write_text_dir(spark.createDataFrame(rows, "id string, text string"), f"file:{tmp_path}/in")
    for name, body in (("_h=1/deep/k.txt", b"bad \xff\xe2( bytes"), ("_off/n.txt", b"n"), (".n.txt", b"n"), ("dir.txt/in.txt", b"in"),
                       ("top.txt", b"top"), ("empty.txt", b""), ("n.csv", b"n")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(body)
    for pattern in (r"id=([^/]+)/", r"([^/]+)\.[^./]+$"):
        got = files.read_text_dir(spark, f"file:{tmp_path}/in", id_pattern=pattern, name_glob="*.txt")
        assert "FileScan" not in got._jdf.queryExecution().executedPlan().toString()  # before: an index of every file in the driver
        want = files.read_text_dir(spark, f"{tmp_path}/in", id_pattern=pattern, name_glob="*.txt")
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    (tmp_path / "none").mkdir()
    assert files.read_text_dir(spark, f"file:{tmp_path}/none", name_glob="*.txt").collect() == []


@pytest.mark.parametrize("reg", [0.1, 2.0])
def test_text_models_of_one_pass_equal_spark_ml(spark, reg):
    """Fold sums give the models that IDF and LinearRegression would, each fitted by itself."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from tessera.operators import ml as ML
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, int(i % 3), ["all", *rng.choice(words, rng.integers(0, 30)).tolist()], float(rng.integers(1, 9)), float(rng.normal()),
             float(rng.normal() * 5 + 3), 4.0) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, kfold int, tokens array<string>, n double, a double, b double, same double")
    targets = ["a", "b", "same"]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one-pass", "models")
    got = {(r["id"], r["target"]): r["pred"] for r in ML.cv_regression(df, "id", targets, "tokens", ["n"], k=3, reg=reg).collect()}
    n_jobs = len(jobs.getJobIdsForGroup("one-pass"))
    spark.sparkContext.setJobGroup("others", "others")
    assert len(got) == 270 and n_jobs < 9  # a fit a fold and target before
    fitted = ML.fit_fold_models(df, targets, "tokens", ["n"], k=3, reg=reg)
    mean = {(r["id"], r["target"]): r["pred"] for r in ML.fold_inference(fitted, df, "id").collect()}
    want = {}
    for f in range(3):
        stages = [HashingTF(inputCol="tokens", outputCol="tf", numFeatures=1024), IDF(inputCol="tf", outputCol="x"),
                  VectorAssembler(inputCols=["x", "n"], outputCol="features")]
        train = df.where(f"kfold <> {f}")
        text = Pipeline(stages=stages).fit(train)
        for t in targets:
            lr = LinearRegression(labelCol=t, predictionCol="pred", regParam=reg, solver="normal").fit(text.transform(train))
            for r in lr.transform(text.transform(df)).select("id", "kfold", "pred").collect():
                want.setdefault((r["id"], t), []).append(r["pred"])
                if r["kfold"] == f:
                    assert abs(got[r["id"], t] - r["pred"]) < 1e-7
    assert all(abs(mean[k] - sum(v) / 3) < 1e-7 for k, v in want.items())


def test_sources_of_folds_without_the_targets(spark):
    """The folds' sources come from one column: no text is read for them."""
    from tessera.plans import common
    from tessera.sources.tables import Tables

    from .conftest import SF_SMALL
    plan = common.essay_folds(Tables(spark, SF_SMALL), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate stack") == 1  # before: once more for the sources
    words = spark.createDataFrame([(" a, b\n\nc.é1!? ",), ("",), (None,)], "t string")
    from tessera.functions.text import ari_parts
    assert [tuple(r) for r in words.select(*ari_parts("t")).collect()][:2] == [(5, 3, 2), (0, 0, 1)]
