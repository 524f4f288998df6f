"""Nulls, repeated rows, clashing columns, empty tables, and the pipeline's stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import (decontaminate, language_id, line_dedup, lm_score, near_dedup, packing, quality_rules, secret_scan,
                         substring_dedup, suffix_dedup)
from tessera.llm.common import remainder

from . import brute

OPERATORS = {
    "language": lambda d: language_id.predict(d, language_id.train(d, remainder(F.col("doc_id"), 5) != 0)),
    "recognised": lambda d: language_id.keep_recognised(d, language_id.train(d)),
    "substring": lambda d: substring_dedup.remove_repeats(d, 12),
    "secrets": lambda d: secret_scan.digest(secret_scan.find_secrets(d)),
    "lm": lambda d: lm_score.score(d, remainder(F.col("doc_id"), 10) != 0, 300),
    "near": near_dedup.components,
    "packing": lambda d: packing.pack(d, size=64),
    "suffix": lambda d: suffix_dedup.remove_repeats(d, 60),
    "lines": lambda d: line_dedup.remove_boilerplate(d, 3),
    "quality": quality_rules.judge_documents,
}
BY_ROW = [n for n in OPERATORS if n not in ("recognised", "packing")]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, docs, name):
    assert OPERATORS[name](docs.filter("doc_id < -1")).collect() == []
    assert OPERATORS[name](spark.createDataFrame([], docs.schema)).collect() == []


@pytest.mark.parametrize("name", BY_ROW)
def test_odd_rows_give_a_row_each(odd, name):
    got = OPERATORS[name](odd).collect()
    assert len(got) == odd.count()
    same = [r.asDict() for r in got if r["doc_id"] == 4]
    assert len(same) == 3
    if name in ("lines",):  # the row number differs
        same = [{k: v for k, v in r.items() if k not in ("text_key", "n")} for r in same]
    assert same[0] == same[1] == same[2]


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "recognised"])
def test_null_texts_only(spark, name):
    rows = spark.createDataFrame([(1, None, None, None), (2, None, "en", "s")], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in OPERATORS[name](rows).collect()} == {1, 2}


def test_decontamination_cases(spark, odd):
    items = spark.createDataFrame([(1, "another text of five"), (1, "another text of five"), (2, None)], "item_id long, text string")
    got = decontaminate.find_leaks(odd, items).collect()
    assert {r["doc_id"] for r in got} == {5} and {r["item_id"] for r in got} == {1}
    assert decontaminate.find_leaks(odd, items.filter("item_id > 5")).collect() == []
    assert decontaminate.find_leaks(odd.filter("doc_id < -1"), items).collect() == []


def test_repeated_rows_repeat_each_other_in_suffix_dedup(odd, corpus):
    got = [r for r in suffix_dedup.remove_repeats(odd, 60).collect() if r["doc_id"] == 4]
    want = brute.remove_strings([corpus[4][1]] * 3, 60)
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == want


@pytest.fixture
def tables(spark, docs, corpus, tmp_path):
    path = str(tmp_path / "sf")
    docs.withColumn("n_chars", F.length("text")).write.parquet(f"{path}/documents.parquet")
    item = " ".join(corpus[17][1].split()[:30])
    spark.createDataFrame([(0, item), (1, "never seen in any text of this corpus at all")],
                          "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_stages(spark, tables, corpus):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, tables)
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns
            kept = {r["doc_id"]: r for r in after}
        if name == "language_id":
            assert not kept.keys() & {150, 151, 153, 157} and len(kept) > 140
        elif name == "line_dedup":
            want = brute.boilerplate([(i, r["text"], r["source"]) for i, r in before.items()], 5, 16)
            assert {i: r["text"] for i, r in kept.items()} == want
            assert all(r["n_chars"] == len(r["text"]) for r in kept.values())
        elif name == "near_dedup":
            want = brute.components([(i, r["text"]) for i, r in before.items()], 5, 80)
            assert kept.keys() == {c for _, c in want.values()}
        elif name == "decontamination":
            gone = before.keys() - kept.keys()
            assert 17 in gone and all(corpus[17][1].split()[5] in before[i]["text"] for i in gone)
        else:
            assert {r["doc_id"] for r in after} == before.keys()


def test_pipeline_runs_whole_and_on_empty_tables(spark, tables, tmp_path):
    rows = corpus_pipeline.run(spark, tables).collect()
    assert len({r["doc_id"] for r in rows}) > 100
    empty = str(tmp_path / "empty")
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))
